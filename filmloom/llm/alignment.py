"""Alignment of two tokenizers' tokens by an associative fragment monoid.

Both tokenizers spell the same bytes, a space and the text. Where a token of each ends at the same byte, the text is cut
into groups; tokens of a group are linked. A byte range of a text is a fragment: an open prefix (what ends at or before its
first common end), closed groups, and an open suffix (what ends behind its last). Neighbours compose by closing the left
one's suffix with the right one's prefix into one group, and composition is associative.

Texts of up to ``CHUNK`` bytes are one fragment. Longer ones are cut into byte ranges, inside tokens as well, that tasks
tokenise for themselves: a range is read from the last place before it to the first behind it that no tokenizer joins over,
and the tokens that end in it are kept. Where such places are far apart, the range is cut at one. A tree fold, ``FAN``
neighbours at a time, carries open prefixes and suffixes only; closed groups stay where they are. A group's ids tell its
bytes, so groups are stored as the two lists of ids.

How many documents hold an id pair linked is summed in tasks before it is shuffled. Pairs that many documents hold, up to a
bounded number of pairs, are looked up in a broadcast table; all others are joined, and as few documents hold one of them,
no key of that join is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm._shared import written
from filmloom.llm._text import STEP
from filmloom.llm._tokens import _MAYBE_SPACE, Vocabulary, byte_bpe, gathered, piece_bpe

#: Bytes of a byte range, fragments composed at a time, pairs in the broadcast table.
CHUNK, FAN, HOT_PAIRS = 1 << 16, 16, 2_000_000
#: Links of a group beyond which its different ids are multiplied; pairs a task holds before it hands them on.
LARGE, HELD = 1 << 14, 2_000_000
_ROW = 20
_DIGITS = Vocabulary.of([str(i).encode() for i in range(1 << 16)])


@dataclass
class Groups:
    """Groups of consecutive rows: tokens of each kind in each group, each group's row, and the ids."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    row: np.ndarray
    rows: int

    def links(self) -> np.ndarray:
        out = np.zeros(self.rows, np.int64)
        np.add.at(out, self.row, self.n_a * self.n_b)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each row's different linked id pairs as (a << 16 | b) << 20 | row, ascending, and the links of each."""
        at_a, at_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        links = self.n_a * self.n_b
        few = np.flatnonzero(links <= LARGE)
        size, n_b = links[few], np.repeat(self.n_b[few], links[few])
        within = gathered(np.zeros(len(few), np.int64), size)
        a = self.a[np.repeat(at_a[few], size) + within // n_b].astype(np.int64)
        b = self.b[np.repeat(at_b[few], size) + within % n_b].astype(np.int64)
        key, count = np.unique((a << 16 | b) << _ROW | np.repeat(self.row[few], size), return_counts=True)
        many = np.flatnonzero(links > LARGE)
        if not len(many):
            return key, count
        keys, counts = [key], [count]
        for g in many.tolist():
            a, times_a = np.unique(self.a[at_a[g] : at_a[g] + self.n_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[at_b[g] : at_b[g] + self.n_b[g]], return_counts=True)
            keys.append(((a.astype(np.int64)[:, None] << 16 | b.astype(np.int64)[None]) << _ROW | int(self.row[g])).ravel())
            counts.append((times_a[:, None] * times_b[None]).ravel())
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, back, np.concatenate(counts))
        return key, count

    def texts(self) -> list[bytes]:
        """Each row's groups as `a1,a2|b1;a3|b2,b3`."""
        total = len(self.a) + len(self.b)
        end_a, end_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[np.arange(len(self.a)) + np.repeat(end_b - self.n_b, self.n_a)] = self.a
        ids[np.arange(len(self.b)) + np.repeat(end_a, self.n_b)] = self.b
        mark[end_a + end_b - self.n_b - 1] = ord("|")
        mark[end_a + end_b - 1] = ord(";")
        size = _DIGITS.sizes(ids) + 1
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if total else 0, np.uint8)
        out[end - 1] = mark
        out[gathered(end - size, size - 1)] = _DIGITS.joined(ids)
        last = np.searchsorted(self.row, np.arange(self.rows), "right")
        stop = np.where(last > 0, end[(end_a + end_b)[last - 1] - 1], 0) if total else np.zeros(self.rows, np.int64)
        begin = np.concatenate([[0], stop[:-1]])
        return [out[x : y - 1].tobytes() if y > x else b"" for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]


def groups(va: Vocabulary, vb: Vocabulary, a: list[np.ndarray], b: list[np.ndarray]) -> Groups:
    """The groups of rows of ids that spell the same bytes, row by row."""
    flat_a, flat_b = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (a, b))
    end_a, end_b = np.cumsum(va.sizes(flat_a)), np.cumsum(vb.sizes(flat_b))
    is_end = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
    is_end[end_a] = True
    common = end_b[is_end[end_b]]
    n_a, n_b = (np.diff(np.searchsorted(x, common, "right"), prepend=0) for x in (end_a, end_b))
    row_end = np.concatenate([[0], end_a])[np.cumsum([len(x) for x in a], dtype=np.int64)] if a else np.zeros(0, np.int64)
    return Groups(flat_a, flat_b, n_a, n_b, np.searchsorted(row_end, common), len(a))


def byte_ranges(full: bytes, chunk: int) -> list[tuple[int, int, int, int]]:
    """(read from, read to, first byte, end) of the byte ranges of a text that begins with a space."""
    d = np.frombuffer(full, np.uint8)
    safe = np.flatnonzero((d[1:-1] == 32) & ~_MAYBE_SPACE[d[:-2]]) + 1
    cuts = [(0, 0, 0)]
    for at in range(chunk, len(full), chunk):
        left, right = np.searchsorted(safe, at, "right"), np.searchsorted(safe, at, "left")
        s, e = int(safe[left - 1]) if left else 0, int(safe[right]) if right < len(safe) else len(full)
        cut = (s, at, e) if e - s <= chunk else (e, e, e)
        if cuts[-1][1] < cut[1] < len(full):
            cuts.append(cut)
    cuts.append((len(full),) * 3)
    return [(x[0], y[2], x[1], y[1]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def encoded(ta, tb, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Both tokenizers' ids of a text that begins with a space; None if either spells other bytes."""
    a, b = ta.ids(text.decode()), tb.ids(text[1:].decode())
    return (a, b) if ta.vocabulary.joined(a).tobytes() == text and tb.vocabulary.joined(b).tobytes() == text else None


def fragment(ta, tb, text: bytes, base: int, lo: int, hi: int) -> tuple | None:
    """(cut, prefix, closed, suffix), each part both lists of ids, of the byte range (lo, hi] of a text read from ``base``."""
    got = encoded(ta, tb, text)
    if got is None:
        return None
    a, b = got
    end_a, end_b = base + np.cumsum(ta.vocabulary.sizes(a)), base + np.cumsum(tb.vocabulary.sizes(b))
    in_a, in_b = (end_a > lo) & (end_a <= hi), (end_b > lo) & (end_b <= hi)
    a, b, end_a, end_b = a[in_a], b[in_b], end_a[in_a], end_b[in_b]
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    none = (a[:0], b[:0])
    if not len(common):
        return False, (a, b), none, none
    (xa, ya), (xb, yb) = (np.searchsorted(e, [common[0], common[-1]], "right") for e in (end_a, end_b))
    return True, (a[:xa], b[:xb]), (a[xa:ya], b[xb:yb]), (a[ya:], b[yb:])


_FRAGMENT = "key bigint, k int, at int, cut boolean, pa binary, pb binary, sa binary, sb binary"
_PIECE = "key bigint, k int, part int, a binary, b binary"


def composed(fragments: pa.Table) -> pa.Table:
    """Up to FAN neighbours of one text as one fragment (part -1), and the groups that closing them gave (part 0).

    ``at`` is the range where the prefix closes; a group has the range where it closes as ``k`` and comes before what that
    range holds closed.
    """
    rows, now = [], None
    for f in sorted(fragments.to_pylist(), key=lambda r: r["k"]):
        if now is None:
            now = f | {"k": f["k"] // FAN}
        elif not now["cut"]:  # nothing closed so far: all of it goes before the next prefix
            now |= {"at": f["at"], "cut": f["cut"], "pa": now["pa"] + f["pa"], "pb": now["pb"] + f["pb"], "sa": f["sa"], "sb": f["sb"]}
        elif not f["cut"]:
            now |= {"sa": now["sa"] + f["pa"], "sb": now["sb"] + f["pb"]}
        else:
            rows.append({"key": f["key"], "k": f["at"], "part": 0, "pa": now["sa"] + f["pa"], "pb": now["sb"] + f["pb"]})
            now |= {"sa": f["sa"], "sb": f["sb"]}
    rows.append(now | {"part": -1})
    names = {"key": pa.int64(), "k": pa.int32(), "part": pa.int32(), "at": pa.int32(), "cut": pa.bool_(), "pa": pa.binary(), "pb": pa.binary(), "sa": pa.binary(), "sb": pa.binary()}
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in names.items()})


@dataclass
class Alignment:
    """``documents``: a row each; ``counts`` (code, n): documents that hold the pair a << 16 | b linked."""

    documents: DataFrame
    counts: DataFrame


def _short(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes()


def _long(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2").astype(np.int32)


class _Held:
    """Documents counted for pairs, merged and handed on before they are too many."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((code, n))
        self.size += len(code)
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            code, back = np.unique(np.concatenate([c for c, _ in self.parts]), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, back, np.concatenate([x for _, x in self.parts]))
            self.parts, self.size = [(code, n)], len(code)

    def taken(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size > least:
            self.merge()
        if self.size > least:
            yield from self.parts
            self.parts, self.size = [], 0


def aligned(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id", chunk: int = CHUNK, hot_pairs: int = HOT_PAIRS) -> Alignment:
    """Every text aligned: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 a document.

    ``a_path`` is a tokenizers file of byte-level BPE and reads a space and the text, ``b_path`` a SentencePiece model that
    puts the space itself; strings of special tokens are plain text. A pair's count is the number of documents that hold it
    linked; ``n_best`` are links whose count is the highest of their A id, ``count_sum`` sums counts over links. The digest
    is of all groups as text.

    A null or empty text, and one that either tokenizer does not spell byte by byte, has zeros and an empty digest and holds
    no pair. Texts of any length are aligned whole; their digest is streamed through one task, as it is a chain. Repeated
    rows and rows without an id are documents of their own; an empty table gives no rows; other columns are left out,
    whatever their names.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    kind = own.schema["i"].dataType.simpleString()
    is_long = F.octet_length("t") > chunk

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ta, tb, key, held = byte_bpe(a_path, True), piece_bpe(b_path), TaskContext.get().partitionId() << 40, _Held()
        id_type = None
        for b in batches:
            ids, texts = b.column("i"), b.column("t").to_pylist()
            id_type, x = ids.type, 0
            while x < len(texts):
                y, size, pairs = x, 0, []
                while y < len(texts) and size < STEP:
                    text = b" " + (texts[y] or "").encode()
                    pairs.append((encoded(ta, tb, text) if len(text) > 1 else None) or (np.zeros(0, np.int32),) * 2)
                    size += len(text)
                    y += 1
                g = groups(ta.vocabulary, tb.vocabulary, [p[0] for p in pairs], [p[1] for p in pairs])
                held.add(*np.unique(g.pairs()[0] >> _ROW, return_counts=True))
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in g.texts()]
                columns = {"key": pa.array(range(key, key + y - x), pa.int64()), "n_a": [len(p[0]) for p in pairs], "n_b": [len(p[1]) for p in pairs], "n_groups": np.bincount(g.row, minlength=y - x), "n_links": g.links(), "sha": sha, "a": [_short(p[0]) for p in pairs], "b": [_short(p[1]) for p in pairs]}
                yield _filled(y - x, {"i": ids.slice(x, y - x)} | columns, id_type)
                key, x = key + y - x, y
                for code, n in held.taken(HELD):
                    yield _filled(len(code), {"code": code, "n": n}, id_type)
        for code, n in held.taken(0):
            yield _filled(len(code), {"code": code, "n": n}, id_type)

    table = written(own.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(near, f"i {kind}, " + ", ".join(f"{n} {t}" for n, t in _NEAR.items())), "aligned")
    short, counts = table.where("code is null"), table.where("code is not null").select("code", "n")
    pieces = short.select("key", "a", "b")
    totals = short.select("i", "key", "n_a", "n_b", "n_groups", "n_links", "sha")

    chunks = written(_chunks(own.where(is_long), kind, chunk), "byte-ranges")
    if not chunks.isEmpty():
        parts = _folded(chunks, a_path, b_path)
        counts = counts.unionByName(_piece_pairs(parts, a_path, b_path))
        pieces = pieces.union(parts.select("key", "a", "b"))
        long = chunks.where("k = 0").select("i", "key").join(_digests(parts, a_path, b_path), "key", "left")
        totals = totals.unionByName(long.select("i", "key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")], F.coalesce("sha", F.lit("")).alias("sha")))

    counts = written(counts.groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    sums = _looked_up(pieces, counts, a_path, b_path, hot_pairs)
    out = totals.join(sums, "key", "left").select(
        F.col("i").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("sha").alias("groups_sha256"),
    )
    return Alignment(out, counts)


_NEAR = {"key": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "sha": "string", "a": "binary", "b": "binary", "code": "bigint", "n": "bigint"}
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}


def _filled(rows: int, columns: dict, id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"i": id_type} | {n: _ARROW[t] for n, t in _NEAR.items()}
    return pa.RecordBatch.from_arrays([columns[n] if isinstance(columns.get(n), pa.Array) else pa.array(columns[n], t) if n in columns else pa.nulls(rows, t) for n, t in kinds.items()], list(kinds))


def _chunks(long: DataFrame, kind: str, chunk: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = -1 - (TaskContext.get().partitionId() << 40)
        for b in batches:
            for r in range(b.num_rows):
                full = b" " + b.column("t")[r].as_py().encode()
                for k, (s, e, lo, hi) in enumerate(byte_ranges(full, chunk)):
                    values = [b.column("i").slice(r, 1), *(pa.array([v], t) for v, t in ((key, pa.int64()), (k, pa.int32()), (full[s:e], pa.binary()), (s, pa.int64()), (lo, pa.int64()), (hi, pa.int64())))]
                    yield pa.RecordBatch.from_arrays(values, ["i", "key", "k", "text", "base", "lo", "hi"])
                key -= 1

    return long.mapInArrow(cut, f"i {kind}, key bigint, k int, text binary, base bigint, lo bigint, hi bigint")


def _folded(chunks: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The groups of long texts: (key, k, part, a, b), in order of k and part within a text."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ta, tb = byte_bpe(a_path, True), piece_bpe(b_path)
        for b in batches:
            for r in b.to_pylist():
                f = fragment(ta, tb, r["text"], r["base"], r["lo"], r["hi"])
                none = (np.zeros(0, np.int32),) * 2
                cut, prefix, closed, suffix = f or (None, none, none, none)
                row = [r["key"], r["k"], r["k"], cut, *map(_short, (*prefix, *suffix, *closed)), f is not None]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 6, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["key", "k", "at", "cut", "pa", "pb", "sa", "sb", "a", "b", "ok"])

    spread = chunks.select("key", "k", "text", "base", "lo", "hi").repartition(F.xxhash64("key", "k"))
    found = written(spread.mapInArrow(ranges, f"{_FRAGMENT}, a binary, b binary, ok boolean"), "fragments")
    found = found.join(found.where("not ok").select("key").distinct(), "key", "left_anti")
    out = found.where("length(a) > 0").select("key", "k", F.lit(1).alias("part"), "a", "b")
    now, last = found.select("key", "k", "at", "cut", "pa", "pb", "sa", "sb"), found.agg(F.max("k")).first()[0] or 0
    while True:
        step = written(now.groupBy("key", F.floor(F.col("k") / FAN).alias("g")).applyInArrow(composed, "key bigint, k int, part int, at int, cut boolean, pa binary, pb binary, sa binary, sb binary"), "folded")
        out = out.union(step.where("part = 0").select("key", "k", "part", F.col("pa").alias("a"), F.col("pb").alias("b")))
        now, last = step.where("part = -1").drop("part"), last // FAN
        if not last:
            break
    # a text's beginning is an end, so its prefix is a group; its end is one, so nothing is left behind
    return written(out.union(now.select("key", F.col("at").alias("k"), F.lit(0).alias("part"), F.col("pa").alias("a"), F.col("pb").alias("b"))), "long-groups")


def _steps(b: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """Rows of ids some at a time: the first row and both lists."""
    a, c, x = b.column("a").to_pylist(), b.column("b").to_pylist(), 0
    while x < len(a):
        y, size = x, 0
        while y < len(a) and size < STEP:
            size += len(a[y])
            y += 1
        yield x, [_long(v) for v in a[x:y]], [_long(v) for v in c[x:y]]
        x = y


def _piece_pairs(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(code, n): long documents that hold a pair."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = byte_bpe(a_path, True).vocabulary, piece_bpe(b_path).vocabulary
        for b in batches:
            keys = b.column("key").to_numpy()
            for x, a, c in _steps(b):
                pair, _ = groups(va, vb, a, c).pairs()
                yield pa.RecordBatch.from_arrays([pa.array(keys[x + (pair & (1 << _ROW) - 1)]), pa.array(pair >> _ROW)], ["key", "code"])

    return parts.select("key", "a", "b").mapInArrow(held, "key bigint, code bigint").distinct().groupBy("code").agg(F.count("*").alias("n"))


def _digests(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each long text: its totals, and the digest streamed over its groups in order."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb, now = byte_bpe(a_path, True).vocabulary, piece_bpe(b_path).vocabulary, None

        def row(now: list) -> pa.RecordBatch:
            values = [now[0], *now[1], now[2].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [*[pa.int64()] * 5, pa.string()], strict=True)], ["key", "n_a", "n_b", "n_groups", "n_links", "sha"])

        for b in batches:
            keys = b.column("key").to_pylist()
            for x, a, c in _steps(b):
                g = groups(va, vb, a, c)
                n_groups, links = np.bincount(g.row, minlength=g.rows).tolist(), g.links().tolist()
                for j, text in enumerate(g.texts()):
                    if now is None or now[0] != keys[x + j]:
                        if now is not None:
                            yield row(now)
                        now = [keys[x + j], [0, 0, 0, 0], hashlib.sha256()]
                    else:
                        now[2].update(b";")
                    now[2].update(text)
                    now[1] = [p + q for p, q in zip(now[1], (len(a[j]), len(c[j]), n_groups[j], links[j]), strict=True)]
        if now is not None:
            yield row(now)

    return parts.repartition("key").sortWithinPartitions("key", "k", "part").select("key", "a", "b").mapInArrow(stream, "key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string")


def _looked_up(pieces: DataFrame, counts: DataFrame, a_path: str, b_path: str, hot_pairs: int) -> DataFrame:
    """(key, n_best, count_sum) of all documents with links."""
    spark = pieces.sparkSession
    size = F.floor(F.log2("n")).cast("int")
    least, n = None, 0
    for r in counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # a row for each power of two
        if n + r["count"] > hot_pairs:
            break
        least, n = r["size"], n + r["count"]
    frequent = counts.where(size >= least) if least is not None else counts.where("false")
    rare = counts.where(size < least) if least is not None else counts
    hot = frequent.orderBy("code").toArrow()
    best = np.zeros(1 << 16, np.int64)
    tops = counts.groupBy(F.shiftright("code", 16).alias("a")).agg(F.max("n").alias("n")).toArrow()  # a row for each A id at most
    best[tops["a"].to_numpy()] = tops["n"].to_numpy()
    sent = spark.sparkContext.broadcast((hot["code"].to_numpy(), hot["n"].to_numpy(), best))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = byte_bpe(a_path, True).vocabulary, piece_bpe(b_path).vocabulary
        codes, n, best = sent.value
        for b in batches:
            keys = b.column("key").to_numpy()
            for x, a, c in _steps(b):
                pair, links = groups(va, vb, a, c).pairs()
                code, row = pair >> _ROW, pair & (1 << _ROW) - 1
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                sums, bests = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
                got = n[at[known]]
                np.add.at(sums, row[known], got * links[known])
                np.add.at(bests, row[known], np.where(got == best[code[known] >> 16], links[known], 0))
                rest = np.flatnonzero(~known)
                rest = rest[np.argsort(row[rest], kind="stable")]
                ends = pa.array(np.searchsorted(row[rest], np.arange(len(a) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v[rest])) for v in (code, links)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[x : x + len(a)]), pa.array(bests), pa.array(sums), *lists], ["key", "n_best", "count_sum", "codes", "links"])

    asked = pieces.mapInArrow(ask, "key bigint, n_best bigint, count_sum bigint, codes array<bigint>, links array<bigint>")
    if rare.isEmpty():
        return asked.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    asked = written(asked, "asked-pairs")
    most = spark.createDataFrame(tops.select(["a", "n"])).withColumnRenamed("n", "most")
    each = asked.select("key", F.explode(F.arrays_zip("codes", "links")).alias("x")).select("key", F.col("x.codes").alias("code"), F.col("x.links").alias("links"))
    each = each.join(rare, "code").join(F.broadcast(most), F.shiftright("code", 16) == F.col("a"))
    each = each.select("key", F.when(F.col("n") == F.col("most"), F.col("links")).otherwise(0).alias("n_best"), (F.col("n") * F.col("links")).alias("count_sum"))
    return asked.select("key", "n_best", "count_sum").union(each).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
