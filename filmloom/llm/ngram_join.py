"""N-gram Jaccard join over a token-group matrix.

A document's set is its distinct n-word shingles, as 64-bit hashes. Equal sets are one class. A class's shingles have a
global order: shingles that recur within a partition last, by their count, the others first by the corpus counts of
their words, least expected first, then by hash. Both counts are kept in tables of a fixed size. The order decides how
much work there is, never what is found. Two sets of sizes a, b with Jaccard similarity t share o = t (a + b) / (1 + t)
shingles or more, so a's first a - o + l and b's first b - o + l shingles share l or more. A class's prefix is that for
the smallest partner, a - ceil(t a) + l, with l growing with its size; for a given partner only so much of it counts.

1. Partition: every class is compared with the most central class (most of its prefix shared) on each of its prefix
   shingles; pairs that share enough are verified, and the components of the links are the groups. That is linear in the
   prefixes, however large a group.
2. Matrix: a group's token union is the set of its members' prefix shingles, stored as rows (token, group) with the
   members' sizes and the earliest place. A class meets the other groups on its prefix; the number of tokens it shares
   with the union, early enough in both, bounds what it can share with any member, so only groups that reach the bound,
   at a size within reach, are opened. Lookalikes below the threshold differ early, so they hardly meet at all.
3. Opened groups: every set has a bitmap with the parity of its shingles per bit, so two bitmaps differ in at most as
   many bits as the sets do in shingles. The class is joined with the group's members on the group, under the condition
   that sizes and bitmaps allow the similarity, and what passes is verified.

Groups are opened only where the class is not of the group already, so no pairs within a group are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.llm._shared import components, forget, written
from filmloom.llm._text import SPACE, Words, mix, shingles, words

#: Sizes of the tables of word and shingle counts, the same for every corpus; how often a shingle recurs in a partition to count.
BUCKETS, SHINGLE_BUCKETS, RECURS = 1 << 17, 1 << 21, 5


def _order_tables(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word bucket the occurrences of its words, per shingle bucket those of shingles that recur in a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, recur = np.zeros(BUCKETS, np.int64), np.zeros(SHINGLE_BUCKETS, np.int32)
        for b in batches:
            for w in words(b.column("text"), SPACE):
                total += np.bincount((w.hash % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                _, h, _ = shingles(w, n)
                u, k = np.unique((h % np.uint64(SHINGLE_BUCKETS)).astype(np.int64), return_counts=True)
                recur[u] += k.astype(np.int32)
        at, more = np.flatnonzero(total), np.flatnonzero(recur >= RECURS)
        for keys, counts in ((at, total[at]), (more + BUCKETS, recur[more].astype(np.int64))):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["bucket", "n"])

    sums = texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    # five bytes a bucket reach the driver: eighths of the logarithm
    got = sums.select(F.col("bucket").cast("int"), F.round(F.log2(F.col("n") + 1) * 8).cast("smallint").alias("e")).toArrow()
    out = np.zeros(BUCKETS + SHINGLE_BUCKETS, np.float32)
    out[got["bucket"].to_numpy()] = got["e"].to_numpy() / 8
    return out[:BUCKETS], out[BUCKETS:].astype(np.float16)


def _need(n: np.ndarray, t: float) -> np.ndarray:
    """Shared shingles that a set of n needs at the least, with a partner of any size."""
    return np.ceil(t * n - 1e-9).astype(np.int64)


def _level(n: Column | np.ndarray, t: float):
    """The l of a set's prefix."""
    return n // 50 + 1 if isinstance(n, np.ndarray) else F.floor(n / 50) + 1


def _sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash, first word), ordered by row and hash."""
    doc, h, at = shingles(w, n)
    o = np.lexsort((h, doc))
    doc, h, at = doc[o], h[o], at[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new], at[new]


def signatures(texts: DataFrame, tables: tuple[np.ndarray, np.ndarray], n: int, t: float) -> DataFrame:
    """Per row: _id, n_shingles, s1 and s2 (a set's fingerprint), prefix."""
    weight = texts.sparkSession.sparkContext.broadcast(tables)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lw, often = weight.value
        for b in batches:
            ids = b.column("_id")
            for w in words(b.column("text"), SPACE):
                rows = w.rows.stop - w.rows.start
                doc, h, at = _sets(w, n)
                size = np.bincount(doc, minlength=rows)
                rare = lw[(w.hash % np.uint64(BUCKETS)).astype(np.int64)] if len(w.hash) else np.zeros(0, np.float32)
                cost = np.zeros(len(doc), np.float32)
                for k in range(n):
                    ok = at + k < w.first[doc + 1]
                    cost[ok] += rare[at[ok] + k]
                cost += 1000 * often[(h % np.uint64(SHINGLE_BUCKETS)).astype(np.int64)].astype(np.float32)
                first = np.concatenate([[0], np.cumsum(size)])
                s1, s2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                has = size > 0
                if has.any():
                    s1[has] = np.add.reduceat(mix(h), first[:-1][has])
                    s2[has] = np.add.reduceat(mix(h ^ np.uint64(0x5BF03635A5A5A5A5)), first[:-1][has])
                o = np.lexsort((h, np.round(cost * 64), doc))
                keep_n = np.minimum(size, size - _need(size, t) + _level(size, t))
                place = np.arange(len(doc)) - first[doc]
                keep = place < keep_n[doc]
                pre = h[o][keep].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(keep_n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.rows.start, rows), pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pre))],
                    ["_id", "n_shingles", "s1", "s2", "prefix"],
                )

    return texts.mapInArrow(sign, "_id bigint, n_shingles bigint, s1 bigint, s2 bigint, prefix array<bigint>")


def _full_sets(texts: DataFrame, n: int) -> DataFrame:
    """(c, set, bits): all shingles, and per bit of 1024 the parity of those that fall on it."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column("text"), SPACE):
                rows = w.rows.stop - w.rows.start
                doc, h, _ = _sets(w, n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows))]).astype(np.int32)
                odd = np.bincount(doc * 1024 + (h >> np.uint64(54)).astype(np.int64), minlength=rows * 1024).astype(np.uint8) & 1
                bits = np.packbits(odd).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(w.rows.start, rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * rows + 1, 16, dtype=np.int32)), pa.array(bits))],
                    ["c", "set", "bits"],
                )

    return texts.mapInArrow(full, "c bigint, set array<bigint>, bits array<bigint>")


def _may_link(x: str, y: str, n: Column, m: Column, t: float) -> Column:
    """Whether bitmaps ``x`` and ``y`` differ in no more bits than linked sets of n and m shingles may."""
    apart = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(16)), F.lit(0))
    return apart <= n + m - 2 * F.ceil((n + m) * (t / (1 + t)) - 1e-9)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union."""
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("set").alias("sb")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(den * F.col("i") >= num * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row with an id: _id, n_shingles, component_id, the smallest id reachable over links of similarity percent / 100 or more.

    Words are runs of other than ASCII white space, A-Z in lower case. Fewer than ``n`` words, but not none, are one
    shingle; a null or empty text has none and is linked with nothing. Rows that share an id are one document only if
    their sets are equal; else each row's set may link the id, and the id has one row for each row. Rows with a null id
    are left out. Very long texts are handled whole, one at a time. An empty table gives an empty result; only the id
    and the text are read, so other columns may have any name.
    """
    t = percent / 100
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("text")).where(F.col("_id").isNotNull())
    sig = written(signatures(texts, _order_tables(texts, n), n, t), "signatures")
    some = sig.where("n_shingles > 0")
    # classes of equal sets
    cls = written(some.groupBy("s1", "s2", "n_shingles").agg(F.min("_id").alias("c")), "classes")
    reps = some.join(cls.select(F.col("c").alias("_id"), "s1", "s2", "c"), ["_id", "s1", "s2"]).dropDuplicates(["c", "s1", "s2"])
    tokens = reps.select("c", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    # 1. partition: tokens of more than one class, and on each the class with the largest part of its prefix shared
    shared = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    every = written(tokens.join(shared, "token"), "shared-tokens")
    sizes = every.groupBy("c").agg(F.first("n").alias("n"), F.count("*").alias("k"))
    # whatever its partner's size, a class needs so many shared tokens
    able = sizes.where(F.col("k") >= F.floor(F.ceil(F.col("n") * t - 1e-9) / 50) + 1).select("c", "k")
    met = written(every.join(able, "c"), "able-tokens")
    forget(every)
    wanted = met.select(F.col("c").alias("_id")).distinct()
    sets = written(_full_sets(texts.join(wanted, "_id", "left_semi"), n), "sets")
    bits = sets.select("c", "bits")
    best = F.min(F.struct((-F.col("k") / F.col("n")).alias("alone"), F.col("c").alias("lead"), F.col("n").alias("m"), F.col("pos").alias("at")))
    leads = met.groupBy("token").agg(best.alias("l")).select("token", "l.lead", "l.m", "l.at")
    lead = met.join(leads, "token").where((F.col("c") != F.col("lead")) & _within("n", "m", t) & _early("pos", "n", F.col("m"), t) & _early("at", "m", F.col("n"), t))
    lead = lead.groupBy("c", "lead", "n", "m").agg(F.count("*").alias("k")).where(_enough(F.col("k"), F.col("n"), F.col("m"), t))
    lead = lead.join(bits.withColumnRenamed("bits", "x"), "c").join(bits.select(F.col("c").alias("lead"), F.col("bits").alias("y")), "lead")
    lead = written(lead.where(_may_link("x", "y", F.col("n"), F.col("m"), t)).select(F.col("c").alias("a"), F.col("lead").alias("b")), "lead-pairs")
    links = written(_verified(lead, sets, percent, 100), "links")
    forget(lead)
    group = written(components(links), "groups")
    grouped = met.join(group.select(F.col("node").alias("c"), F.col("component").alias("g")), "c", "left")
    grouped = written(grouped.select("token", "c", "n", "pos", F.coalesce("g", "c").alias("g")), "grouped-tokens")
    forget(met)
    forget(group)
    # 2. matrix: the groups' token unions; on each token the sizes of the members and how early one of them has it
    union = grouped.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min(_lateness("pos", "n", t)).alias("late"))
    several = union.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token")
    union = union.join(several, "token", "left_semi").withColumnRenamed("g", "h")
    ask = grouped.join(several, "token", "left_semi")
    # sizes within reach, a place early enough in both sets, and each pair of groups from one side only
    low = F.greatest(F.col("least"), F.ceil(F.col("n") * t - 1e-9))
    reach = (F.col("most") >= F.ceil(F.col("n") * t - 1e-9)) & (F.col("least") <= F.floor(F.col("n") / t + 1e-9))
    reach = reach & _early("pos", "n", low, t) & (F.col("late") < 1e-6 - F.col("n") * (t / (1 + t)))
    bound = ask.join(union, "token").where((F.col("g") > F.col("h")) & reach).groupBy("c", "n", "g", "h").agg(F.count("*").alias("k"), F.min("least").alias("least"))
    opened = bound.where(_enough(F.col("k"), F.col("n"), F.greatest(F.col("least"), F.ceil(F.col("n") * t - 1e-9)), t)).select("c", "n", "h")
    opened = written(opened, "opened")
    # 3. members of opened groups whose size and bitmap allow a link
    asking = opened.join(bits, "c").withColumnRenamed("bits", "x")
    members = grouped.select("c", "n", "g").distinct().join(bits, "c").select(F.col("g").alias("h"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("bits").alias("y"))
    pairs = asking.join(members, "h").where(_within("n", "m", t) & _may_link("x", "y", F.col("n"), F.col("m"), t))
    pairs = written(pairs.select(F.col("c").alias("a"), F.col("d").alias("b")), "member-pairs")
    forget(opened)
    forget(grouped)
    more = written(_verified(pairs, sets, percent, 100), "more-links")
    forget(pairs)
    forget(sets)
    roots = components(links.union(more))
    forget(links)
    forget(more)
    out = cls.join(roots.withColumnRenamed("node", "c"), "c", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "c").alias("component_id"))
    return sig.join(out, ["s1", "s2", "n_shingles"], "left").select("_id", "n_shingles", F.coalesce("component_id", "_id").alias("component_id"))


def _enough(k: Column, n: Column, m: Column, t: float) -> Column:
    return k >= F.least(_level(n, t), _level(m, t))


def _within(n: str, m: str, t: float) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return (F.col(m) >= F.ceil(F.col(n) * t - 1e-9)) & (F.col(n) >= F.ceil(F.col(m) * t - 1e-9))


def _lateness(pos: str, n: str, t: float) -> Column:
    """A partner of m shingles shares o = t (n + m) / (1 + t) or more, so l of them are among the first n - o + l: those where this is below -m t / (1 + t)."""
    return F.col(pos) - _level(F.col(n), t) - F.col(n) * (1 / (1 + t))


def _early(pos: str, n: str, m: Column, t: float) -> Column:
    return _lateness(pos, n, t) < 1e-6 - m * (t / (1 + t))
