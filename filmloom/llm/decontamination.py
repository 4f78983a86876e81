"""Benchmark decontamination by a generalised suffix automaton of the benchmark's items.

The items' word sequences go into one automaton. A document's words stream through it, each step keeping the longest
suffix that occurs in some item; where that suffix reaches a window's length, the document holds the window. Words that
no item has, and word pairs that no item has, reset the match to length 0 and 1, so numpy finds the runs of known pairs
and only those long enough to hold a window walk the automaton.

Items are dealt by hash to blocks of about ``block_words`` words; a block's automaton is what the driver builds and
broadcasts, so its size does not grow with the benchmark: more items make more blocks. Documents stream past one block
after another, the spans found so far written to the shared folder between them and the block's automaton let go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm._shared import forget, written
from filmloom.llm._text import ALNUM, mix, words

_ODD = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Automaton:
    """Generalised suffix automaton over word hashes, with what each state tells about windows."""

    window: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set[int]] = field(default_factory=lambda: [set()])
    whole: dict[int, tuple[int, set[int]]] = field(default_factory=dict)  # state -> words of a short item, items
    shortest: int = 1 << 30

    def _add(self, last: int, w: int, item: int) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            if length[q] == length[last] + 1:
                self.items[q].add(item)
                return q
            clone = self._clone(q, length[last] + 1)
            p = last
            while p >= 0 and step[p].get(w) == q:
                step[p][w] = clone
                p = link[p]
            self.items[clone].add(item)
            return clone
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.items.append({item})
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = cur
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = self._clone(q, length[p] + 1)
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = clone
                    p = link[p]
                link[cur] = clone
        return cur

    def _clone(self, q: int, length: int) -> int:
        clone = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(length)
        self.items.append(set())
        self.link[q] = clone
        return clone

    def build(self, items: list[tuple[int, list[int]]]) -> Automaton:
        """``items``: (number, word hashes). Items without words are left out."""
        for number, seq in items:
            last = 0
            for w in seq:
                last = self._add(last, w, number)
        order = sorted(range(1, len(self.step)), key=lambda s: -self.length[s])
        for s in order:  # a state's string also occurs wherever those that end with it do
            if self.link[s] > 0:
                self.items[self.link[s]] |= self.items[s]
        for number, seq in items:
            if not seq:
                continue
            self.shortest = min(self.shortest, min(len(seq), self.window))
            if len(seq) < self.window:
                s = 0
                for w in seq:
                    s = self.step[s][w]
                self.whole.setdefault(s, (len(seq), set()))[1].add(number)
        # per state: the ancestor that stands for its last `window` words, and short items among its suffixes
        self.at_window = [-1] * len(self.step)
        self.short: list[tuple[int, ...]] = [()] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=lambda s: self.length[s]):
            up = self.link[s]
            self.short[s] = self.short[up] + ((s,) if s in self.whole else ())
            if self.length[s] >= self.window:
                self.at_window[s] = s if self.length[up] < self.window else self.at_window[up]
        vocab = sorted({w for _, seq in items for w in seq})
        self.vocab = np.array(vocab, np.uint64)
        pairs = [mix(np.array([a], np.uint64) * _ODD + np.array([b], np.uint64))[0] for a, b in {(a, b) for _, seq in items for a, b in zip(seq, seq[1:], strict=False)}]
        self.pairs = np.sort(np.array(pairs, np.uint64))
        return self

    def walk(self, seq: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """Occurrences of windows in ``seq``: (first word, end, items)."""
        step, link, length = self.step, self.link, self.length
        s = n = 0
        for i, w in enumerate(seq, 1):
            while s and w not in step[s]:
                s = link[s]
                n = length[s]
            if w in step[s]:
                s = step[s][w]
                n += 1
            else:
                n = 0
                continue
            if n >= self.window:
                yield i - self.window, i, self.items[self.at_window[s]]
            for short in self.short[s]:
                k, of = self.whole[short]
                if k <= n:
                    yield i - k, i, of


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


def hits(col: pa.Array, auto: Automaton) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[int]], list[list[tuple[int, int]]]]:
    """Per text: words, hit word ranges, items with an occurring window, and the hit ranges in bytes of the text."""
    rows = len(col)
    n_words = np.zeros(rows, np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    bytes_: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    found: list[set[int]] = [set() for _ in range(rows)]
    for w in words(col, ALNUM):
        n_words[w.rows] = np.diff(w.first)
        total = len(w.doc)
        if not total or not len(auto.vocab):
            continue
        known = _member(auto.vocab, w.hash)
        # runs: consecutive known words of one text whose neighbouring pairs are known too
        cut = np.ones(total + 1, bool)
        cut[1:-1] = True
        both = known[:-1] & known[1:] & (w.doc[:-1] == w.doc[1:])
        at = np.flatnonzero(both)
        joined = at[_member(auto.pairs, mix(w.hash[at] * _ODD + w.hash[at + 1]))]
        cut[joined + 1] = False
        edges = np.flatnonzero(cut)
        begin, end = edges[:-1], edges[1:]
        want = known[begin] & (end - begin >= auto.shortest)
        origin = _offsets(w, col)
        for a, b in zip(begin[want].tolist(), end[want].tolist(), strict=True):
            d = int(w.doc[a])
            row, base = w.rows.start + d, int(w.first[d])
            mine = spans[row]
            for i, j, of in auto.walk(w.hash[a:b].tolist()):
                found[row] |= of
                i, j = a + i - base, a + j - base
                while mine and i <= mine[-1][1] and mine[-1][0] >= i:
                    j = max(j, mine.pop()[1])
                if mine and i <= mine[-1][1]:
                    mine[-1] = (mine[-1][0], max(j, mine[-1][1]))
                else:
                    mine.append((i, j))
        for d in np.unique(w.doc[begin[want]]).tolist():
            row, base = w.rows.start + d, int(w.first[d])
            bytes_[row] = [(int(w.start[base + i] - origin[d]), int(w.end[base + j - 1] - origin[d])) for i, j in spans[row]]
    return n_words, spans, found, bytes_


def _offsets(w, col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(col.slice(w.rows.start, w.rows.stop - w.rows.start)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(size)])


def item_blocks(bench: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[bool, list[tuple[str, list[int]]]]]:
    """The items as (id as text, word hashes), one block after another, each with whether it is the last."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column("t"), ALNUM):
                h = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hash.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("i").slice(w.rows.start, len(h)), h], ["i", "h"])

    items = bench.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text_col}`").alias("t")).mapInArrow(hashed, "i string, h array<bigint>")
    items = written(items, "benchmark-items")
    total = items.agg(F.coalesce(F.sum(F.size("h")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).orderBy("i", "h").toArrow()
        yield k == blocks - 1, [(i, np.array(h, np.int64).view(np.uint64).tolist()) for i, h in zip(own["i"].to_pylist(), own["h"].to_pylist(), strict=True)]
    forget(items)


def benchmark_hits(docs: DataFrame, bench: DataFrame, window: int = 10, block_words: int = 500_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (sorted item ids as strings) and hit_bytes (byte ranges of hit spans).

    A window is ``window`` consecutive item words (a shorter item is one window); document words inside an occurrence
    are hit. Null and empty texts have no words; texts of any length are read whole; repeated rows stay, and items that
    share an id are that item together; empty tables give no rows and no hits; columns named like the new ones are
    replaced.
    """
    cols = [c for c in docs.columns if c not in ("n_words", "n_hit", "hit_items", "hit_bytes")]
    own = _passed(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]), f"c{cols.index(text_col)}", item_blocks(bench, item_id, item_text, block_words), window)
    n_hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    return own.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)],
        F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.col("_items").alias("hit_items"), F.col("_bytes").alias("hit_bytes"),
    )


def _passed(own: DataFrame, name: str, blocks: Iterator[tuple[bool, list[tuple[str, list[int]]]]], window: int, finish: Callable | None = None) -> DataFrame:
    """``own``, its columns named c0, c1 and so on, with _n, _spans, _items and _bytes.

    With ``finish`` it has its own columns only: the rows that ``finish`` makes, in the pass of the last block, of a batch
    of them, its texts' words, hit word ranges and hit byte ranges.
    """
    spark = own.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    kept = own.columns
    first, between, sent = True, [], None
    for last, block in blocks:
        if not first:
            own = written(own, "block-hits")
            between.append(own)
            sent.unpersist()
            for table in between[:-1]:
                forget(table)
            between = between[-1:]
        auto = Automaton(window).build([(k, seq) for k, (_, seq) in enumerate(block)])
        sent = spark.sparkContext.broadcast((auto, [i for i, _ in block]))
        end = finish if last else None

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, first=first, end=end) -> Iterator[pa.RecordBatch]:
            auto, ids = sent.value
            for b in batches:
                n, spans, found, byte_spans = hits(b.column(name), auto)
                items = [[ids[k] for k in s] for s in found]
                if not first:
                    for row, (had_spans, had_items) in enumerate(zip(b.column("_spans").to_pylist(), b.column("_items").to_pylist(), strict=True)):
                        if had_spans:
                            spans[row] = _union(spans[row] + [(s["a"], s["b"]) for s in had_spans])
                            items[row] = items[row] + had_items
                    byte_spans = _byte_spans(b.column(name), spans)
                mine = b.select(kept)
                if end:
                    yield end(mine, n, spans, byte_spans)
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        *mine.columns,
                        pa.array(n),
                        pa.array([[{"a": a, "b": z} for a, z in s] for s in spans], _SPANS),
                        pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                        pa.array([[{"a": a, "b": z} for a, z in s] for s in byte_spans], _SPANS),
                    ],
                    [*kept, "_n", "_spans", "_items", "_bytes"],
                )

        base = own if first else own.select(*kept, "_spans", "_items")
        own = base.mapInArrow(scan, fields if end else f"{fields}, _n bigint, _spans array<struct<a:bigint,b:bigint>>, _items array<string>, _bytes array<struct<a:bigint,b:bigint>>")
        first = False
    return own


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _byte_spans(col: pa.Array, spans: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in spans]
    for w in words(col, ALNUM, hashed=False):
        origin = _offsets(w, col)
        for d in range(w.rows.stop - w.rows.start):
            base = int(w.first[d])
            out[w.rows.start + d] = [(int(w.start[base + a] - origin[d]), int(w.end[base + b - 1] - origin[d])) for a, b in spans[w.rows.start + d]]
    return out


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = 500_000, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without what they share with the benchmark; the columns stay as they are.

    Hit spans are cut out of the text, a space in their place. A document of which more than ``max_coverage`` is hit
    goes altogether. Documents without a hit keep their text byte for byte.
    """
    at = docs.columns.index(text_col)

    def cut(b: pa.RecordBatch, n: np.ndarray, spans: list[list[tuple[int, int]]], byte_spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        n_hit = np.array([sum(z - a for a, z in s) for s in spans], np.int64)
        keep = (n_hit == 0) | (n_hit <= max_coverage * n)
        dirty = np.flatnonzero(keep & (n_hit > 0))
        if len(dirty):
            texts = b.column(at).to_pylist()
            for i in dirty.tolist():
                t, parts, last = texts[i].encode(), [], 0
                for a, z in byte_spans[i]:
                    parts.append(t[last:a])
                    last = z
                texts[i] = b" ".join([*parts, t[last:]]).decode()
            b = b.set_column(at, b.schema.names[at], pa.array(texts, b.column(at).type))
        return b if keep.all() else b.filter(pa.array(keep))

    # in the same pass, so that texts walk the automaton once and a task has one Python worker
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = _passed(own, f"c{at}", item_blocks(bench, item_id, item_text, block_words), window, cut)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def digest(items: list[str]) -> str:
    """SHA-256 of sorted item ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
