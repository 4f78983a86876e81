"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

A source's weight is a piecewise-linear function of training time 0..1. Its integral, scaled to the source's target,
is the source's cumulative token demand; inverting it at a document's place among its source's tokens gives the time at
which the document is due. Documents are range-sorted by that time.

Places are prefix sums in the order of md5(doc_id). They are taken in two levels, first over buckets of a common md5
prefix, then inside each bucket. A source of n rows has about sqrt(n) buckets of sqrt(n) rows, so no task gets a whole
source, nor all rows of one. Sizes are counted once, into a table without texts, which all sums are taken from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmloom.llm._shared import written

#: (time, relative weight) knots by parity of a source's rank: odd ranks fade, even ranks grow. Both integrate to one.
FADING, GROWING = ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, max_repeat: int = 3) -> DataFrame:
    """Per source: source_size, rank, weight, target. ``sized`` has source and size.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share the sum of all sizes by weight; a target
    stops at ``max_repeat`` times its source's size and the excess is shared again by weight until none is above. That
    is the level at which, with sources sorted by cap per weight, those before are full and the rest share what is left.
    The windows run over one row per source in one task: sources are kinds of data, so dozens or thousands, not rows.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("bigint")).withColumn("cap", F.col("source_size") * max_repeat)
    every = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    onward = every.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(whole))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward).cast("double"))
    full = F.col("cap").cast("double") <= F.col("level") * F.col("weight")
    s = s.withColumn("open_level", F.first(F.when(~full, F.col("level")), ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("open_level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("open_level") * F.col("weight")))
    return s.select("source", "source_size", "n_docs", "rank", "weight", target.alias("target"))


def due_time(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's integral reaches ``share`` of its whole."""
    parts, area = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        parts.append((t0, t1, a, b, area))
        area += (a + b) / 2 * (t1 - t0)
    out = F.lit(float(knots[-1][0]))
    for t0, t1, a, b, c0 in reversed(parts):
        own = (a + b) / 2 * (t1 - t0)
        u = share * area - c0
        slope = (b - a) / (t1 - t0)
        t = F.lit(t0) + (u / a if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * u)) - a) / slope)
        out = F.when(u < own, t).otherwise(out)
    return out


def mixed(docs: DataFrame, max_repeat: int = 3, keep: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per document: _key (the columns ``keep``, else all, in a struct), size, source_size, target, copies, taken, position, due.

    A source's documents are taken in md5 order, over and over, until its target is reached; a document belongs to the
    last, partial pass if its middle word does. ``copies`` is how often it is taken, ``taken`` copies x size, ``position``
    the time (0..1) it is first due, null if it is not taken, ``due`` the times of all its copies, one per pass. Null and
    empty texts have size 0 and take nothing, however long ones are counted whole; a null source is a source of its own;
    of rows with one id any order is as good, as they differ only in what they hold. Repeated rows count one by one. An
    empty table gives an empty result. Columns may have any name, as they stay inside _key. Only what is in ``keep`` is
    shuffled.
    """
    keep = docs.columns if keep is None else keep
    key = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_key")
    plain = [F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("h")]
    light = text_col not in keep
    sized = written(docs.select(*([key] if light else []), *plain), "mix-sizes")
    d = sized if light else docs.select(key, *plain)
    per = source_targets(sized, max_repeat)
    digits = F.ceil(F.log(F.col("n_docs").cast("double")) / (2 * F.log(F.lit(16.0)))).cast("int")
    per = written(per.withColumn("digits", digits), "sources")

    def of_source(rows: DataFrame, *cols: str) -> DataFrame:
        on = rows["source"].eqNullSafe(per["source"])
        return rows.join(per, on).select(*cols, "size", "h", F.coalesce("rank", F.lit(0)).alias("rank"), "source_size", "target", F.col("h").substr(F.lit(1), F.col("digits")).alias("bucket"))

    placed = of_source(d, "_key")
    sums = of_source(sized).groupBy("rank", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.join(sums, ["rank", "bucket"]).withColumn("place", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.least(F.lit(float(max_repeat)), F.floor(F.col("target") / F.col("source_size")))
    rest = F.col("target") - passes * F.col("source_size")
    last = F.when((passes < max_repeat) & (F.col("place") + F.col("size") / 2.0 < rest), 1).otherwise(0)
    copies = F.when(F.col("source_size") > 0, passes + last).otherwise(0).cast("bigint")
    at = at.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("bigint"))

    def time(turn: Column) -> Column:
        share = F.least(F.lit(1.0), (F.col("place") + turn * F.col("source_size")) / F.col("target"))
        return F.when(F.col("rank") % 2 == 1, due_time(share, FADING)).otherwise(due_time(share, GROWING))

    due = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1), time))
    return at.select(
        "_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, time(F.lit(0))).alias("position"), F.coalesce(due, F.array().cast("array<double>")).alias("due"), F.col("h").alias("_h"),
    )


def training_order(mix: DataFrame, each_copy: bool = False) -> DataFrame:
    """The mix range-sorted by due time; documents that are not taken follow, dealt evenly by hash.

    With ``each_copy`` a document has a row for every copy, with that copy's time as ``position``; without, one row, at
    the time it is first due.
    """
    if each_copy:
        mix = mix.withColumn("position", F.explode_outer("due"))
    late = 1 + F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    return mix.orderBy(F.coalesce("position", late), "_h").drop("_h")
