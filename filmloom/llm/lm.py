"""Language-model scoring by a weighted backoff automaton of word n-grams, up to trigrams.

Every n-gram of every training text counts; none is left out for being rare. The automaton's states are the contexts
(two words, one word, none), its arcs the n-grams. With n the counts, a context h of one or two words, and h' the
context without its first word, the arc of w weighs

    p(w | h) = (n(h w) + K p(w | h')) / (n(h) + K),    p(w) = (n(w) + 1/2) / (N + (V + 1) / 2)

and where h has no arc for w, the failure arc to h' weighs K / (n(h) + K): the same sum with n(h w) = 0, so the weights
of a context add up to one. A text is read once from left to right: the state is the longest context, the word's arc is
taken or failure arcs followed until there is one, and the log-probabilities add up.

No task holds the whole automaton. Texts are packed into chunks of about ``CHUNK`` tokens. A chunk asks for the counts
of its distinct n-grams, each once however often it occurs in the chunk, as sorted 64-bit keys; the key space is cut
into shards of about ``SHARD_KEYS`` asked keys, each of which adds up what the chunks have seen and answers every chunk.
Words and pairs are asked for first: a trigram of which a pair is in no other chunk is in no other chunk either, so only
the others are asked for then. From the answers a chunk builds the part of the automaton that its own texts walk through, exactly as the whole would
have it. A common n-gram is asked for once by each chunk, so keys are hot in no shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.llm._shared import forget, release, written
from filmloom.llm._text import SPACE, mix, words

CHUNK, SHARD_KEYS = 3 << 18, 2_000_000
#: How many occurrences the lower order is worth, behind one word and behind two; ``tuning`` tries others inside the training rows.
WORTH = (10000.0, 3.0)
_START, _END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
_BY = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def held_out(id_col: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds == fold


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first all their first bytes, then all their second ones, and so on."""
    flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(flat).to_bytes(8, "little") + (pa.compress(flat, codec="zstd", asbytes=True) if flat else b"")


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).reshape(-1)


def _key(x: np.ndarray, order: int) -> np.ndarray:
    return mix(x) & ~np.uint64(3) | np.uint64(order)


class Grams:
    """The n-grams of a chunk.

    ``keys[o]`` are the sorted, distinct keys of order o + 1, ``at[o]`` the place of every position's n-gram among them,
    -1 where there is none, and ``some[o]`` a position of each key. A text's positions are its start, words and end.
    """

    def __init__(self, vocab: np.ndarray, ids: np.ndarray, lengths: np.ndarray, orders: int = 3):
        self.text = np.repeat(np.arange(len(lengths)), lengths + 2)
        begin = np.cumsum(lengths + 2) - (lengths + 2)
        mark = np.zeros(len(self.text), bool)
        mark[begin] = mark[begin + lengths + 1] = True
        number = np.empty(len(mark), np.int64)
        number[~mark] = ids
        number[begin], number[begin + lengths + 1] = len(vocab), len(vocab) + 1
        hashes = np.concatenate([vocab, [_START, _END]])
        h = hashes[number]
        self.token = np.ones(len(mark), bool)
        self.token[begin] = False
        third = self.token.copy()
        third[begin + 1] = False
        self.keys, self.at, self.some = [], [], []
        # words are distinct already
        one = _key(hashes * _BY[0], 1)
        order = np.argsort(np.delete(one, len(vocab)))
        rank = np.full(len(hashes), -1, np.int64)
        rank[np.delete(np.arange(len(hashes)), len(vocab))[order]] = np.arange(len(order))
        self.end = int(rank[-1])
        self._add(np.delete(one, len(vocab))[order], rank[number])
        if orders > 1:
            two = np.flatnonzero(self.token)
            self._sorted(_key(h[two - 1] * _BY[0] + h[two] * _BY[1], 2), two)
        if orders > 2:
            three = np.flatnonzero(third)
            self._sorted(_key(h[three - 2] * _BY[0] + h[three - 1] * _BY[1] + h[three] * _BY[2], 3), three)

    def _sorted(self, keys: np.ndarray, where: np.ndarray) -> None:
        u, place = np.unique(keys, return_inverse=True)
        at = np.full(len(self.text), -1, np.int64)
        at[where] = place
        self._add(u, at)

    def _add(self, keys: np.ndarray, at: np.ndarray) -> None:
        where = np.flatnonzero(at >= 0)
        some = np.zeros(len(keys), np.int64)
        some[at[where]] = where
        self.keys.append(keys)
        self.at.append(at)
        self.some.append(some)

    def seen(self, train: np.ndarray, order: int) -> np.ndarray:
        """How often the chunk's training texts have each key of an order."""
        own = self.at[order - 1][train[self.text] & (self.at[order - 1] >= 0)]
        return np.bincount(own, minlength=len(self.keys[order - 1]))

    def elsewhere(self, shared: np.ndarray) -> np.ndarray:
        """The trigrams that other chunks may have: those of which both pairs are in others; ``shared``: whether a pair is."""
        two, j = self.at[1], self.some[2]
        return shared[two[j - 1]] & shared[two[j]]


class Automaton:
    """States and arcs that the texts of a chunk walk through; ``n``: the training counts of the keys of every order of ``g``."""

    def __init__(self, g: Grams, n: list[np.ndarray], tokens: int, kinds: int, worths: tuple[float, float] = WORTH):
        self.g, self.n, self.word_log = g, n, np.log10((n[0] + 0.5) / (tokens + 0.5 * (kinds + 1)))
        p = 10.0**self.word_log
        self.arc, self.fail = [], []
        for o, worth in zip((1, 2), worths, strict=True):
            j = g.some[o]  # an n-gram's arc is that of any of its occurrences
            context = g.at[o - 1][j - 1]
            if o == 1:  # the start mark is a context as often as there are ends
                context = np.where(context >= 0, context, g.end)
            h = n[o - 1][context].astype(np.float64)
            p = (n[o] + worth * p[g.at[o - 1][j]]) / (h + worth)
            self.arc.append(np.where(n[o] > 0, np.log10(p), -np.inf))
            self.fail.append(np.log10(worth / (h + worth)))

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 of every token: its arc from the longest context, or the failure arcs down to one that has it."""
        g = self.g
        base = np.where(g.token, self.word_log[g.at[0]], 0.0)
        score, todo = np.zeros(len(base)), g.token.copy()
        for o in (2, 1):
            has = np.flatnonzero(todo & (g.at[o] >= 0))
            at = g.at[o][has]
            arc = self.arc[o - 1][at]
            taken = np.isfinite(arc)
            score[has] += np.where(taken, arc, self.fail[o - 1][at])
            todo[has[taken]] = False
        score[todo] += base[todo]
        return base, score


def chunks(docs: DataFrame, train: Column, cols: list[str], text_col: str, chunk_tokens: int) -> DataFrame:
    """(chunk, tokens, train_tokens, rows, vocab, ids): texts of about ``chunk_tokens`` tokens; a longer text is a chunk of its own."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text_col}`").alias("text"))
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in own.schema.fields if f.name != "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        h: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        rows: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            all_h, n = np.concatenate(h), np.concatenate(lengths)
            t = pa.Table.from_batches(rows).combine_chunks()
            vocab, ids = np.unique(all_h, return_inverse=True)
            learn = t["train"].to_numpy()
            struct = pa.StructArray.from_arrays([*[c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in t.columns], pa.array(n)], [*t.schema.names, "n"])
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 33 | number]), pa.array([len(all_h) + len(n)]), pa.array([int((n[learn] + 1).sum())]), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), struct), pa.array([_pack(vocab)], pa.binary()), pa.array([_pack(ids.astype(np.uint32))], pa.binary())],
                ["chunk", "tokens", "train_tokens", "rows", "vocab", "ids"],
            )

        for b in batches:
            for w in words(b.column(b.num_columns - 1), SPACE):
                here = w.rows.stop - w.rows.start
                if rows and size + len(w.hash) + here > chunk_tokens:
                    yield flush()
                    number += 1
                    h.clear(), lengths.clear(), rows.clear()
                    size = 0
                h.append(w.hash)
                lengths.append(np.diff(w.first).astype(np.int64))
                rows.append(b.slice(w.rows.start, here).drop_columns(["text"]))
                size += len(w.hash) + here
        if rows:
            yield flush()

    return own.mapInArrow(pack, f"chunk bigint, tokens bigint, train_tokens bigint, rows array<struct<{fields},n:bigint>>, vocab binary, ids binary")


def _grams(b: pa.RecordBatch | pa.Table, i: int, orders: int = 3) -> tuple[Grams, np.ndarray, pa.StructArray]:
    rows = b["rows"][i].values
    g = Grams(_unpack(b["vocab"][i].as_py(), np.uint64), _unpack(b["ids"][i].as_py(), np.uint32), rows.field("n").to_numpy(), orders)
    return g, rows.field("train").to_numpy(zero_copy_only=False), rows


def _asks(chunk: int, order: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.Table:
    """(shard, chunk, n, keys, counts) of a chunk's sorted keys of an order."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else np.zeros(0, np.int64)
    cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=False))
    same = lambda x, kind: pa.array(np.full(len(at), x), kind)
    return pa.table(
        {"shard": pa.array(shard[at].astype(np.int32)), "chunk": same(chunk, pa.int64()), "n": same(order, pa.int32()), "keys": pa.array([_pack(np.diff(keys[a:z], prepend=np.uint64(0))) for a, z in cuts], pa.binary()), "counts": pa.array([_pack(counts[a:z].astype(np.uint32)) for a, z in cuts], pa.binary())}
    )


def _answers(asks: DataFrame) -> DataFrame:
    """(chunk, n, shard, totals, kinds): of a chunk's keys in a shard twice the training count, plus one if other chunks have the key.

    Chunk -1 has the shard's number of distinct training words.
    """

    def add(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in t["keys"]]
        counts = np.concatenate([_unpack(x.as_py(), np.uint32) for x in t["counts"]])
        u, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, counts, minlength=len(u)).astype(np.uint64)
        kinds = int(((u & np.uint64(3)) == 1)[total > 0].sum())
        shared = (np.bincount(place) > 1).astype(np.uint64)  # a chunk asks for a key once
        back = np.split((total * np.uint64(2) + shared)[place], np.cumsum([len(k) for k in keys])[:-1])
        n = t.num_rows
        return pa.table(
            {
                "chunk": pa.array([*t["chunk"].to_pylist(), -1], pa.int64()), "n": pa.array([*t["n"].to_pylist(), 0], pa.int32()), "shard": pa.array([t["shard"][0].as_py()] * (n + 1), pa.int32()),
                "totals": pa.array([*map(_pack, back), None], pa.binary()), "kinds": pa.array([0] * n + [kinds], pa.int64()),
            }
        )

    return asks.groupBy("shard").applyInArrow(add, "chunk bigint, n int, shard int, totals binary, kinds bigint")


def _told(t: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts that the answers give for an order, and whether other chunks have the keys, as the keys were asked for."""
    own = sorted((s, x) for s, n, x in zip(t["shard"].to_pylist(), t["n"].to_pylist(), t["totals"].to_pylist(), strict=True) if n == order)
    told = np.concatenate([np.zeros(0, np.int64), *[_unpack(x, np.uint64).astype(np.int64) for _, x in own]])
    return told >> 1, told & 1 > 0


def scores(docs: DataFrame, train: Column, text_col: str = "text", chunk_tokens: int = CHUNK, shard_keys: int = SHARD_KEYS, worths: tuple[float, float] = WORTH) -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score and score; learnt from the rows where ``train`` is true.

    Words are runs of other than ASCII white space, A-Z in lower case; a text is its words and one end. Null and empty
    texts are the end alone. Repeated rows stay, count as often as they occur and have equal scores. Columns named like
    the new ones are replaced. An empty table gives an empty result; without training rows every word is unknown.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    cols = [c for c in docs.columns if c != text_col and c not in new]
    packed = written(chunks(docs, train, cols, text_col, chunk_tokens), "lm-chunks")
    size = packed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"), F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("train")).first()
    shards = max(1, -(-size["all"] // shard_keys))
    fields = "shard int, chunk bigint, n int, keys binary, counts binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                g, train, _ = _grams(b, i, 2)
                for order in (1, 2):
                    yield from _asks(b["chunk"][i].as_py(), order, g.keys[order - 1], g.seen(train, order), shards).to_batches()

    def ask_more(chunk: pa.Table, told: pa.Table) -> pa.Table:
        g, train, _ = _grams(chunk.combine_chunks(), 0)
        want = g.elsewhere(_told(told, 2)[1])
        return _asks(chunk["chunk"][0].as_py(), 3, g.keys[2][want], g.seen(train, 3)[want], shards)

    two = written(_answers(packed.mapInArrow(ask, fields)), "lm-pairs")
    release(docs.sparkSession)
    kinds, tokens = two.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("k")).first()["k"], size["train"]
    asked = packed.groupBy("chunk").cogroup(two.where("chunk >= 0").groupBy("chunk")).applyInArrow(ask_more, fields)
    three = written(_answers(asked), "lm-trigrams")
    del asked
    release(docs.sparkSession)
    totals = two.union(three).where("chunk >= 0")

    def score(chunk: pa.Table, told: pa.Table) -> pa.Table:
        g, train, rows = _grams(chunk.combine_chunks(), 0)
        two, shared = _told(told, 2)
        three = g.seen(train, 3)
        three[g.elsewhere(shared)] = _told(told, 3)[0]
        a = Automaton(g, [_told(told, 1)[0], two, three], tokens, kinds, worths)
        base, full = a.read()
        n, known = (np.bincount(g.text, x, minlength=len(rows)) for x in (g.token, g.token & (a.n[0][g.at[0]] > 0)))
        own = [rows.field(f"c{i}") for i in range(len(cols))]
        return pa.Table.from_arrays(
            [*own, pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(rows), tokens, np.int64)), *[pa.array(np.bincount(g.text, x, minlength=len(rows))) for x in (base, full)]],
            [*[f"c{i}" for i in range(len(cols))], *new],
        )

    kept = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    fields = "".join(f"c{i} {kept[c]}, " for i, c in enumerate(cols))
    out = packed.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, f"{fields}n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    out = written(out, "lm-scores")
    for table in (packed, two, three):
        forget(table)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], *new)
