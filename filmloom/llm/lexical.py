"""Ranked lexical search over norm buckets.

A document is a vector of impacts, an item a vector of term weights, and a score their inner product; coordinates that no
item has are left out, as they add nothing. Vectors are ordered by length, longest first, and dealt to partitions in that
order, equal lengths by a hash. A partition is read in buckets of vectors of similar length. With the length of an item,
a bucket's longest vector bounds every score in the bucket (Cauchy-Schwarz), so it is passed over for items whose
threshold is higher, and so is all that follows. Inside a bucket an item's heaviest coordinates are taken first, some at a
time: what they add up to and the product of the lengths of what is left bound the score, and vectors below the threshold
are dropped. Survivors are scored again in 64-bit integers.

The longest vectors are searched first. Their best scores are the thresholds with which all others begin; partitions raise
them as they find more. Thresholds never cut what would tie, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.llm._shared import forget, written
from filmloom.llm._text import ALNUM, words

#: Terms of items searched at once, vectors that give the first thresholds, cells of a bucket's matrix, and a bucket's shortest vector against its longest.
BLOCK_TERMS, SEEDS, CELLS, SIMILAR = 60_000, 4096, 1 << 21, 0.9
#: Heaviest coordinates after which bounds are taken; what rounding may take from a bound.
FOCUS, SLACK = (4, 12, 28), 1 + 1e-9


def term_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[pa.Table]:
    """The different items with terms, as (i: id, h: hashes of different terms), one bounded block after another."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column("t"), ALNUM):
                at = w.first.tolist()
                terms = [np.unique(w.hash[x:y]).view(np.int64) for x, y in zip(at[:-1], at[1:], strict=True)]
                part = b.slice(w.rows.start, len(terms))
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(terms, pa.list_(pa.int64())), part.column("k")], ["i", "h", "k"])

    own = items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).dropDuplicates().withColumn("k", F.xxhash64("i", "t"))
    kind = own.schema["i"].dataType.simpleString()
    own = written(own.mapInArrow(hashed, f"i {kind}, h array<bigint>, k bigint").where(F.size("h") > 0), "item-terms")
    blocks = max(1, -(-(own.agg(F.sum(F.size("h")).alias("n")).first()["n"] or 0) // block_terms))
    for k in range(blocks):
        block = own.where(F.pmod("k", F.lit(blocks)) == k).toArrow()
        if block.num_rows:
            yield block
    forget(own)


def _found(texts: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some consecutive rows: their terms with repeats, and (row, term, occurrences) of terms of the vocabulary."""
    for w in words(texts, ALNUM):
        at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
        known = vocabulary[at] == w.hash
        key, tf = np.unique(w.doc[known] * len(vocabulary) + at[known], return_counts=True)
        yield w.rows, np.diff(w.first), key // len(vocabulary), key % len(vocabulary), tf


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    at = np.searchsorted(row, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """(1e9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L."""
    wide = n.astype(object) if 50 * int(n.max(initial=0)) * documents >= 1 << 63 else n
    m = 50 + (50 * wide * documents // all_terms).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Best:
    """The ``top`` best (score, id) so far: highest score first, then smallest id, null last."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor, self.rows = top, floor, []

    def add(self, scores: list[int], ids: list) -> None:
        rows = self.rows + list(zip(scores, ids, strict=True))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        self.rows = rows[: self.top]
        if len(self.rows) == self.top:
            self.floor = max(self.floor, self.rows[-1][0])


class Searcher:
    """Items' weights over a block's vocabulary, and the best documents of each in one partition."""

    def __init__(self, item_terms: list[np.ndarray], weight: np.ndarray, top: int, floors: np.ndarray):
        self.terms, self.weights, self.lengths, self.rest = [], [], [], []
        for terms in item_terms:
            own = terms[np.argsort(-weight[terms], kind="stable")]
            w = weight[own]
            left = np.sqrt(np.maximum(0, np.cumsum((w.astype(float) ** 2)[::-1])[::-1]))  # length of what is left from each coordinate on
            self.terms.append(own)
            self.weights.append(w)
            self.lengths.append(float(left[0]))
            self.rest.append(np.append(left, 0.0))
        self.best = [Best(top, int(f)) for f in floors]
        self.vocabulary = len(weight)

    def bucket(self, ids: pa.Array, row: np.ndarray, term: np.ndarray, impact: np.ndarray, length: np.ndarray) -> bool:
        """Search vectors whose ``length`` is at most the first one's; False if all items pass them over."""
        opened = [k for k, best in enumerate(self.best) if self.lengths[k] * length[0] * SLACK >= best.floor]
        if not opened:
            return False
        d = np.zeros((self.vocabulary, len(length)), np.int64)
        d[term, row] = impact
        heaviest = d.max(axis=1)
        square, order = length**2, None
        for k in opened:
            terms, w, best = self.terms[k], self.weights[k], self.best[k]
            if int((w * heaviest[terms]).sum()) < best.floor or not w.any():
                continue
            alive, seen, seen_square, at = None, 0.0, 0.0, 0
            for focus in FOCUS:
                if focus >= len(terms):
                    break
                own = d[terms[at:focus]] if alive is None else d[terms[at:focus]][:, alive]
                seen = seen + w[at:focus] @ own
                seen_square = seen_square + (own.astype(float) ** 2).sum(axis=0)
                left = np.sqrt(np.maximum(0, (square if alive is None else square[alive]) * SLACK - seen_square))
                keep = np.flatnonzero((seen + self.rest[k][focus] * left) * SLACK >= best.floor)
                alive, seen, seen_square, at = keep if alive is None else alive[keep], seen[keep], seen_square[keep], focus
                if not len(alive):
                    break
            if alive is not None and not len(alive):
                continue
            score = w @ (d[terms] if alive is None else d[terms][:, alive])
            good = np.flatnonzero((score >= max(best.floor, 1)))
            if len(good):
                score, alive = score[good], good if alive is None else alive[good]
                if len(score) > best.top:
                    if order is None:
                        order = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy(zero_copy_only=False)
                    first = np.lexsort((order[alive], -score))[: best.top]
                    score, alive = score[first], alive[first]
                best.add(score.tolist(), ids.take(pa.array(alive)).to_pylist())
        return True


def ranked(docs: DataFrame, items: DataFrame, top: int = 50, text_col: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, seeds: int = SEEDS) -> DataFrame:
    """Each item's ``top`` best documents with a score above 0: ``item_id``, rank, ``id_col``, score; all if there are fewer.

    Equal scores are ranked by ascending id, null last. A null or empty text, of a document or an item, has no terms and no
    result. Texts of any length are read whole. Repeated documents, and documents without an id, are documents of their
    own; repeated items are one, and items that share an id but not a text have a ranking each. Empty tables give no
    result; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    kind, item_kind = own.schema["i"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out = None
    for block in term_blocks(items, item_id, item_text, block_terms):
        hashes = [np.array(h, np.int64).view(np.uint64) for h in block["h"].to_pylist()]
        vocabulary = np.unique(np.concatenate(hashes))
        item_terms = [np.searchsorted(vocabulary, h) for h in hashes]
        found = _search(own, kind, vocabulary, item_terms, top, seeds)
        keys = spark.createDataFrame(pa.table({"k": pa.array(range(len(hashes)), pa.int32()), "item": block["i"].combine_chunks()}), f"k int, item {item_kind}")
        found = found.join(F.broadcast(keys), "k").drop("k")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], f"rank int, i {kind}, score bigint, item {item_kind}")
    return out.select(F.col("item").alias(item_id), "rank", F.col("i").alias(id_col), "score")


def _search(own: DataFrame, kind: str, vocabulary: np.ndarray, item_terms: list[np.ndarray], top: int, seeds: int) -> DataFrame:
    """(k: number of the item, rank, i: id, score) for the items of one block."""
    spark, n_terms = own.sparkSession, len(vocabulary)
    sent = spark.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, n, row, term, tf in _found(b.column("t"), sent.value):
                columns = [b.column("i").slice(rows.start, len(n)), pa.array(n), _lists(row, term, len(n)), _lists(row, tf, len(n))]
                yield pa.RecordBatch.from_arrays(columns, ["i", "n", "terms", "tf"])

    counts = written(own.mapInArrow(counted, f"i {kind}, n bigint, terms array<int>, tf array<int>"), "term-counts")
    sizes = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    documents, all_terms = int(sizes["documents"]), max(1, int(sizes["terms"]))

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for b in batches:
            n += np.bincount(b.column("terms").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["term", "n"])

    # a row for each of the block's terms at most
    df = np.zeros(n_terms, np.int64)
    held = counts.select("terms").mapInArrow(holding, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[held["term"].to_numpy()] = held["n"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, tf = b.column("terms"), b.column("tf").flatten().to_numpy().astype(np.int64)
            size = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), size)
            v = impacts(tf, b.column("n").to_numpy()[row], documents, all_terms)
            length = np.sqrt(np.bincount(row, v.astype(float) ** 2, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("i"), terms, _lists(row, v, b.num_rows), pa.array(length)], ["i", "terms", "impacts", "length"])

    vectors = counts.where(F.size("terms") > 0).mapInArrow(weighed, f"i {kind}, terms array<int>, impacts array<int>, length double")
    vectors = vectors.where("length > 0").repartitionByRange(F.desc("length"), F.xxhash64("i", "terms")).sortWithinPartitions(F.desc("length"))
    vectors = written(vectors.withColumn("bucket", F.floor(F.log("length") / -math.log(SIMILAR)).cast("int")), "impact-vectors")
    forget(counts)

    # the longest vectors: buckets from the top until they hold ``seeds``; a row for each bucket, some hundreds
    lowest, n = 0, 0
    for r in vectors.groupBy("bucket").count().orderBy(F.desc("bucket")).collect():
        lowest, n = r["bucket"], n + r["count"]
        if n >= seeds:
            break

    def search(part: DataFrame, floors: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((item_terms, weight, floors))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, kept = Searcher(shared.value[0], shared.value[1], top, shared.value[2]), None
            for b in batches:
                b = b.sort_by([("length", "descending")])  # a partition may hold several files
                kept = b.schema.field("i").type
                size = pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(size)])
                term, impact, length = b.column("terms").flatten().to_numpy(), b.column("impacts").flatten().to_numpy(), b.column("length").to_numpy()
                x, most, any_open = 0, max(16, CELLS // n_terms), True
                while x < b.num_rows and any_open:
                    y = min(x + most, b.num_rows, int(np.searchsorted(-length, -SIMILAR * length[x], "right")))
                    row = np.repeat(np.arange(y - x), size[x:y])
                    any_open = s.bucket(b.column("i").slice(x, y - x), row, term[at[x] : at[y]], impact[at[x] : at[y]], length[x:y])
                    x = y
            rows = [(k, i, score) for k, best in enumerate(s.best) for score, i in best.rows]
            if rows:
                k, i, score = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, kept), pa.array(score, pa.int64())], ["k", "i", "score"])

        return part.select("i", "terms", "impacts", "length").mapInArrow(scan, f"k int, i {kind}, score bigint")

    first = written(search(vectors.where(F.col("bucket") >= lowest), np.zeros(len(item_terms), np.int64)), "seed-scores")
    nth = Window.partitionBy("k").orderBy(F.desc("score"))
    floors = np.zeros(len(item_terms), np.int64)
    for r in first.withColumn("at", F.row_number().over(nth)).where(F.col("at") == top).select("k", "score").collect():  # a row an item of the block
        floors[r["k"]] = r["score"]
    rest = search(vectors.where(F.col("bucket") < lowest), floors)
    # twice, so that what all partitions keep for one item is not sorted in one task
    order = [F.desc("score"), F.asc_nulls_last("i")]
    best = first.union(rest).withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("k", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("k", "rank", "i", "score")
