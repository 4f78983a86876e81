"""Token counts by a compiled finite-state transducer.

A SentencePiece BPE vocabulary without white space inside pieces is compiled, as words call for it, into a
deterministic transducer over characters whose transitions carry the number of tokens they add (it may be negative,
when a longer piece replaces several). Pair compatibility makes BPE finite-state: a token sequence is the encoding of
its text exactly if each token encodes to itself and every two neighbours encode to these two. So what a prefix
contributes to its future is the last token at each of the last few positions where a piece can still be open; that
list is the state.

Every text is a chain of segments, each a run of spaces with the word behind it, and no piece crosses a segment's end.
The machine over whole texts therefore has two kinds of states: inside a run of spaces (how far into the longest piece of
spaces) and inside a word (the transducer's state, and whether the spaces before it filled whole pieces).

Texts of more than ``chunk`` characters are cut into chunks anywhere, inside words as well. A chunk's state map takes an
entry state to the exit state and the tokens emitted on the way. It is tabulated for all entries that the characters
before the chunk allow: one, where a word begins among them; otherwise those that starts at each of as many places as the
longest piece has characters lead to, as a token begins at one of these. Most starts lead to one state, and in periodic
texts to one for each phase. Maps compose by a tree fold: ``FAN`` neighbours at a time, level by level, where a map's exit
must be an entry of the next. Should it be none, the chunk is tabulated for that entry as well and the fold is done again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm._shared import written
from filmloom.llm._text import words

SPACE_MARK = "▁"
_ONLY_SPACE = (np.arange(256, dtype=np.uint8), np.arange(256) != 32)
#: Longest run of spaces that is one piece is read from the vocabulary; compiled states and cached words are dropped beyond these.
MAX_STATES, MAX_CACHE = 250_000, 300_000
#: A node with at most so many pieces under it stays open only if one of them may follow the last token.
FEW = 60
#: Maps composed at a time, characters before a chunk that tell its entry states, and what checks a model.
FAN, WARM = 64, 256
PROBES = ["", " ", "a", "  two  spaces ", "tab\tline\nend\r\n", "\uff21\ufb01\u2460 e\u0301 \u00e9 \u1e9b\u0323", "\u3000wide\u00a0hard\u200b", "\u2581mark", "\U0001f642 \u68a6\u0000 <s> </s>"]


def _entry(node: int, last: int, rel: int, lone: int) -> int:
    """An open position: trie node of the characters since, token before it, its count less the current one, lone first space."""
    return node << 32 | (last + 2) << 16 | (rel + 0x4000) << 1 | lone


class Transducer:
    """``count(word)``: tokens of a word behind one space, and whether that space stays a token of its own."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank: dict[str, float] = {}
        self.run = 1
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            p = sp.id_to_piece(i)
            if not p.strip(SPACE_MARK):
                self.run = max(self.run, len(p))
                if len(p) > 1:
                    continue
            elif SPACE_MARK in p[1:]:
                raise ValueError(f"a piece has white space inside: {p!r}")
            self.rank[p] = -sp.get_score(i)
        self.token = {p: i for i, p in enumerate(self.rank)}
        self.longest = max(map(len, self.rank))
        runs = {p for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if p and not p.strip(SPACE_MARK)}
        least = [0]  # a run without a piece of its own is two pieces; the probes below tell if that is not so
        for r in range(1, self.run):
            least.append(1 if SPACE_MARK * r in runs else 1 + least[1])
        self.rest = np.array(least, np.int64)
        self.text = list(self.rank)
        self.trie: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for p, t in self.token.items():
            at = 0
            for c in p:
                nxt = self.trie[at].get(c)
                if nxt is None:
                    nxt = self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = t
        self.below = [[t] if t >= 0 else [] for t in self.ends]  # tokens at or under a node, where they are few
        for node in range(len(self.trie) - 1, -1, -1):  # children come after their parent
            for child in self.trie[node].values():
                self.below[node] = None if self.below[node] is None or self.below[child] is None else self.below[node] + self.below[child]
                if self.below[node] is not None and len(self.below[node]) > FEW:
                    self.below[node] = None
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.open: dict[int, bool] = {}
        self.cache: dict[int, int] = {}
        self._reset()
        for t in [*PROBES, *("x" + " " * k + e for k in range(1, 2 * self.run + 2) for e in ("", "y"))]:
            if int(self.counts(_marked(pa.array([t]), True))[0]) != len(sp.encode(t)):
                raise ValueError(f"not a model with the identity normaliser, a dummy prefix and byte fallback: it counts {t!r} otherwise")

    def _reset(self) -> None:
        self.known: dict[tuple, int] = {}
        self.live: list[tuple] = []
        self.moves: dict[int, int] = {}
        self.start = self._state((_entry(0, self.token[SPACE_MARK], 0, 1), _entry(self.trie[0][SPACE_MARK], -2, -1, 0)))

    def _state(self, live: tuple) -> int:
        s = self.known.get(live)
        if s is None:
            s = self.known[live] = len(self.live)
            self.live.append(live)
        return s

    def merged(self, text: str) -> list[str]:
        """BPE of ``text``: the best pair first, the leftmost of equals."""
        part = list(text)
        while len(part) > 1:
            best, at = None, -1
            for i in range(len(part) - 1):
                r = self.rank.get(part[i] + part[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            part[at : at + 2] = [part[at] + part[at + 1]]
        return part

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes ``piece``; None for a character and for a piece that BPE never makes."""
        if piece not in self.halves:
            part = list(piece)
            while len(part) > 2:
                best, at = None, -1
                for i in range(len(part) - 1):
                    r = self.rank.get(part[i] + part[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                part[at : at + 2] = [part[at] + part[at + 1]]
            self.halves[piece] = (part[0], part[1]) if len(part) == 2 else None
        return self.halves[piece]

    def whole(self, piece: str) -> bool:
        return len(piece) == 1 or self.split(piece) is not None

    def apart(self, a: str, b: str) -> bool:
        """Whether BPE keeps the boundary between two whole pieces: undo merges, latest first, and look for a better one across."""
        rank, limit = self.rank, float("inf")
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit:
                return False
            ra, rb = (rank[a] if len(a) > 1 else -1.0), (rank[b] if len(b) > 1 else -1.0)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.split(a)[1]
            else:
                limit, b = rb + 0.5, self.split(b)[0]  # of equals the left one, across, comes first

    def _fits(self, last: int, t: int) -> bool:
        key = (last + 2) << 20 | t
        got = self.pairs.get(key)
        if got is None:
            b = self.text[t]
            got = self.whole(b) and (last < 0 or self.apart(self.text[last], b))
            if len(self.pairs) > 600_000:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def _open(self, node: int, last: int) -> bool:
        """Whether some longer piece through ``node`` may still follow ``last``."""
        if not self.trie[node]:
            return False
        few = self.below[node]
        if few is None:
            return True
        key = (last + 2) << 20 | node
        got = self.open.get(key)
        if got is None:
            mine = self.ends[node]
            got = any(self._fits(last, t) for t in few if t != mine)
            if len(self.open) > 600_000:
                self.open.clear()
            self.open[key] = got
        return got

    def _move(self, s: int, c: str) -> int:
        """The transition of state ``s`` under ``c``: next state and emitted tokens, packed."""
        grown, found = [], None
        for e in self.live[s]:
            child = self.trie[e >> 32].get(c)
            if child is None:
                continue
            last, rel, lone = (e >> 16 & 0xFFFF) - 2, (e >> 1 & 0x7FFF) - 0x4000, e & 1
            if self._open(child, last):
                grown.append((child, last, rel, lone))
            t = self.ends[child]
            if t >= 0 and found is None and self._fits(last, t):
                found = (t, rel + 1, lone if last != -2 else 0)
        if found is None:  # a character without a piece is spelled in bytes; nothing merges with it
            found = (-1, len(c.encode("utf-8", "surrogatepass")), self.live[s][0] & 1)
        t, emit, lone = found
        live = (_entry(0, t, 0, lone), *(_entry(n, last, rel - emit, ln) for n, last, rel, ln in grown))
        if len(self.live) > MAX_STATES:
            self._reset()
            return self._state(live) << 8 | emit + 128
        got = self.moves[s << 21 | ord(c)] = self._state(live) << 8 | emit + 128
        return got

    def count(self, word: str) -> tuple[int, bool]:
        s, n, moves = self.start, 1, self.moves.get
        for c in word:
            got = moves(s << 21 | ord(c))
            if got is None:
                got = self._move(s, c)
                moves = self.moves.get
            s = got >> 8
            n += (got & 255) - 128
        return n, bool(self.live[s][0] & 1)

    def through(self, state: bytes, text: str) -> tuple[bytes, int]:
        """The state behind ``text`` from a state before it, and the tokens emitted on the way.

        A state is [r] inside spaces, r + 1 of which (modulo the longest piece) have been read and all but the first
        counted, or [j, live...] inside a word, j being what changes if the space before it joins those before that.
        """
        own = np.frombuffer(state, np.int64).tolist()
        n, i, last = 0, 0, len(text)
        if len(own) == 1:
            while i < last and text[i] == " ":
                i += 1
            n += self.spaces(own[0] + i) - self.spaces(own[0])
            r = (own[0] + i) % self.run
            if i == last:
                return self._frozen([r]), n
            joins, s = self.joining(r), self.start
            n += 1
        else:
            joins, s = own[0], self._state(tuple(own[1:]))
        at = text.find(" ", i)
        s, more = self._walk(s, text[i : last if at < 0 else at])
        n += more
        if at < 0:
            return self._frozen([joins, *self.live[s]]), n
        n += self._ended(joins, s)
        rest = text[at:]
        whole = rest.rstrip(" ")
        if len(whole) < len(rest):
            k = len(rest) - len(whole)
            return self._frozen([(k - 1) % self.run]), n + int(self.counts(pa.array([whole]))[0]) + self.spaces(k - 1)
        word = rest.rfind(" ") + 1
        inside = rest[:word].rstrip(" ")
        k = word - len(inside)
        s, more = self._walk(self.start, rest[word:])
        return self._frozen([self.joining((k - 1) % self.run), *self.live[s]]), n + int(self.counts(pa.array([inside]))[0]) + self.spaces(k - 1) + 1 + more

    def entries(self, before: str) -> list[bytes]:
        """The states that a text whose last characters are ``before``, and which has more than these, may be in."""
        for i in range(len(before) - 1, 0, -1):
            if before[i] == " " and before[i - 1] != " ":  # a segment begins here
                return [self.through(BEGIN, before[i + 1 :])[0]]
        word, joins = before.lstrip(" "), sorted({self.joining(r) for r in range(self.run)})
        if not word:
            return [self._frozen([r]) for r in range(self.run)]
        if len(word) < len(before):
            return [self._frozen([j, *self.live[self._walk(self.start, word)[0]]]) for j in joins]
        # inside a word that began earlier: from behind any token, whatever came of the spaces before the word
        out = {}
        for lone in (0, 1):
            for start in range(min(self.longest, len(word))):
                s = self._walk(self._state((_entry(0, -1, 0, lone),)), word[start:])[0]
                out |= {self._frozen([j, *self.live[s]]): None for j in joins}
        return list(out)

    def end(self, state: bytes) -> int:
        """The tokens that a text's end adds in a state."""
        own = np.frombuffer(state, np.int64).tolist()
        return self.spaces(own[0] + 1) - self.spaces(own[0]) if len(own) == 1 else self._ended(own[0], self._state(tuple(own[1:])))

    def _ended(self, joins: int, s: int) -> int:
        """What a word's end adds: where the space before the word stays a token of its own, it joins the spaces before it."""
        return joins if self.live[s][0] & 1 else 0

    def spaces(self, k):
        """Tokens of ``k`` spaces: whole longest pieces and what is left, for which there may be no single piece."""
        return k // self.run + self.rest[k % self.run]

    def joining(self, r: int) -> int:
        """What changes where a space joins ``r`` others, whole longest pieces aside, instead of being a token of its own."""
        return int(self.spaces(r + 1) - self.spaces(r) - 1)

    def _walk(self, s: int, word: str) -> tuple[int, int]:
        n = 0
        for c in word:
            got = self.moves.get(s << 21 | ord(c))
            if got is None:
                got = self._move(s, c)
            s = got >> 8
            n += (got & 255) - 128
        return s, n

    @staticmethod
    def _frozen(state: list[int]) -> bytes:
        return np.array(state, np.int64).tobytes()

    def _packed(self, h: int, word: bytes) -> int:
        got = self.cache.get(h)
        if got is None:
            if len(self.cache) > MAX_CACHE:
                self.cache.clear()
            n, lone = self.count(word.decode("utf-8", "replace"))
            got = self.cache[h] = n * 2 + lone
        return got

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text of a column, each taken as a chain of whole segments without a space put before it."""
        total = np.zeros(len(texts), np.int64)
        for w in words(texts, _ONLY_SPACE):
            rows = w.rows.stop - w.rows.start
            of = np.zeros(rows, np.int64)
            size = _row_sizes(w, texts)
            at = np.concatenate([[0], np.cumsum(size)])
            if len(w.doc):
                u, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
                starts, ends = w.start[where].tolist(), w.end[where].tolist()
                blob = w.data.tobytes()
                packed = np.array([self._packed(h, blob[a:b]) for h, a, b in zip(u.tolist(), starts, ends, strict=True)], np.int64)[back]
                n, lone = packed >> 1, packed & 1
                before = np.empty(len(w.doc), np.int64)
                before[1:] = w.end[:-1]
                before[0] = 0
                before = np.maximum(before, at[w.doc])
                k = w.start - before
                np.add.at(of, w.doc, np.where(lone == 1, n - 1, n) + self.spaces(np.where(lone == 1, k, k - 1)))
            last = at[:-1].copy()
            has = np.diff(w.first) > 0
            last[has] = w.end[w.first[1:][has] - 1]
            of += self.spaces(at[1:] - last)
            total[w.rows] = of
        return total


def _row_sizes(w, texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts.slice(w.rows.start, w.rows.stop - w.rows.start)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


_compiled: dict[str, Transducer] = {}


def compiled(model_path: str) -> Transducer:
    if model_path not in _compiled:
        _compiled[model_path] = Transducer(model_path)
    return _compiled[model_path]


def _marked(texts: pa.Array, prefix: bool) -> pa.Array:
    import pyarrow.compute as pc

    texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE_MARK, " ")
    if not prefix:
        return texts
    return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))


#: The state at a text's beginning: the dummy prefix has been read.
BEGIN = np.array([0], np.int64).tobytes()
_MAPS = "_row string, _k int, first int, entry binary, exit binary, n bigint, missing int"


def _table(rows: list[tuple]) -> pa.Table:
    """Rows of a state map: group of chunks, its first chunk, entry, exit, tokens; ``missing``: the chunk that lacks the exit as an entry, else -1."""
    kinds = [("_row", pa.string()), ("_k", pa.int32()), ("first", pa.int32()), ("entry", pa.binary()), ("exit", pa.binary()), ("n", pa.int64()), ("missing", pa.int32())]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [name for name, _ in kinds])


def composed(maps: pa.Table) -> pa.Table:
    """The map of up to FAN neighbouring groups of one text: what each entry of the first leads to behind the last."""
    groups: dict[int, dict[bytes, dict]] = {}
    for r in maps.to_pylist():
        groups.setdefault(r["_k"], {})[r["entry"]] = r
    out = []
    order = sorted(groups)
    for entry, r in groups[order[0]].items():
        state, n, missing = r["exit"], r["n"], r["missing"]
        for k in order[1:]:
            if missing >= 0:
                break
            own = groups[k].get(state)
            if own is None:
                missing = next(iter(groups[k].values()))["first"]
                break
            state, n, missing = own["exit"], n + own["n"], own["missing"]
        out.append((r["_row"], order[0] // FAN, r["first"], entry, state, n, missing))
    return _table(out)


def _long_counts(long: DataFrame, model_path: str, chunk: int) -> DataFrame:
    """(_row, _n) of the distinct texts ``long`` (_row, _t): the fold of their chunks' state maps."""
    most = long.agg(F.max(F.length("_t")).alias("m")).first()["m"] or 0
    starts = F.sequence(F.lit(1), F.length("_t"), F.lit(chunk))
    cut = long.select("_row", "_t", F.posexplode(starts).alias("_k", "_at"))
    warm = F.when(F.col("_k") > 0, F.col("_t").substr(F.greatest(F.lit(1), F.col("_at") - WARM), F.least(F.lit(WARM), F.col("_at") - 1)))
    cut = cut.select("_row", "_k", F.col("_t").substr(F.col("_at"), F.lit(chunk)).alias("_t"), warm.alias("warm"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model_path)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text, warm = (x and x.replace(SPACE_MARK, " ") for x in (r["_t"], r["warm"]))
                for entry in [r["entry"]] if r.get("entry") else [BEGIN] if warm is None else t.entries(warm):
                    state, n = t.through(entry, text)
                    rows.append((r["_row"], r["_k"], r["_k"], entry, state, n, -1))
            yield from _table(rows).to_batches()

    known = written(cut.mapInArrow(maps, _MAPS), "state-maps")
    while True:
        fold, groups = known, -(-most // chunk)
        while True:
            fold = fold.groupBy("_row", F.floor(F.col("_k") / FAN).alias("g")).applyInArrow(composed, _MAPS)
            groups = -(-groups // FAN)
            if groups <= 1:
                break
        fold = written(fold.where(F.col("entry") == F.lit(BEGIN)), "folded-maps")
        wrong = fold.where("missing >= 0")
        if wrong.isEmpty():
            break
        asked = wrong.select("_row", F.col("missing").alias("_k"), F.col("exit").alias("entry"))
        known = written(known.union(cut.join(asked, ["_row", "_k"]).mapInArrow(maps, _MAPS)), "state-maps")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["_row"], pa.array([n + t.end(x) for n, x in zip(b["n"].to_pylist(), b["exit"].to_pylist(), strict=True)], pa.int64())], ["_row", "_n"])

    return fold.mapInArrow(ends, "_row string, _n bigint")


def with_token_counts(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens", chunk: int = 65_536) -> DataFrame:
    """``docs`` with the number of tokens of ``text_col`` as a bigint column ``out_col``, replacing one of that name.

    Counts equal SentencePiece's for BPE models with the identity normaliser, a dummy prefix and byte fallback; other
    models raise a ValueError. Null and empty texts count 0; texts of any length are counted whole; repeated rows stay;
    an empty table gives an empty result; other columns pass through, whatever their names.
    """
    cols = [c for c in docs.columns if c != out_col]
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    text = F.col(f"c{cols.index(text_col)}")
    name = f"c{cols.index(text_col)}"
    short = own.where(text.isNull() | (F.length(text) <= chunk))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model_path)
        for b in batches:
            n = t.counts(_marked(b.column(name), True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], [*b.schema.names, "_n"])

    counted = short.mapInArrow(whole, f"{fields}, _n bigint")

    # long texts, each distinct one once
    long = own.where(F.length(text) > chunk).withColumn("_row", F.md5(text))
    sums = _long_counts(long.select("_row", text.alias("_t")).dropDuplicates(["_row"]), model_path, chunk)
    out = counted.unionByName(long.join(sums, "_row").drop("_row"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], F.col("_n").alias(out_col))
