"""Loss levels of block copies, rate control, running exclusive ors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, by loss level: largest ordinary error, largest exceptional luma error, totals of 4x4 and of 2x2 blocks.
THRESHOLDS = [
    (0, 0, 0, 0), (0, 1, 2, 1), (0, 1, 4, 2), (1, 1, 6, 2), (1, 1, 8, 2), (1, 2, 10, 3), (1, 2, 12, 3), (1, 2, 14, 4), (1, 2, 16, 4), (1, 2, 18, 5),
    (1, 2, 20, 5), (1, 2, 24, 6), (1, 2, 28, 7), (1, 3, 32, 8), (1, 3, 36, 9), (1, 3, 48, 12), (2, 3, 48, 12), (2, 4, 48, 12), (2, 4, 72, 18), (2, 5, 96, 24),
    (2, 6, 96, 24), (3, 6, 100, 28), (3, 7, 132, 33), (4, 8, 144, 36), (4, 9, 180, 45), (5, 10, 180, 45), (5, 11, 195, 48), (6, 12, 198, 50), (6, 13, 216, 60),
]


def first_level(most: Column, over: list[Column], chroma: Column, total: Column, block: int = 4) -> Column:
    """The strictest level that accepts a copy, else 29, from its profile: largest luma error, pixels over each error, chroma error, sum."""
    rare, column = (4, 2) if block == 4 else (1, 3)
    out = F.lit(len(THRESHOLDS)).cast("bigint")
    for level in reversed(range(len(THRESHOLDS))):
        t = THRESHOLDS[level]
        out = F.when((most <= t[1]) & (over[t[0]] <= rare) & (chroma <= t[0]) & (total <= t[column]), F.lit(level).cast("bigint")).otherwise(out)
    return out


def rate_level(size: Callable[[Column], Column], start: Column, target: int, low: float = 0.9, high: float = 1.025) -> Column:
    """(level, retries): where one-level retries from ``start`` end; ``size`` gives the bytes at a level.

    Below the window the level falls until it is not below, above it it rises until it is not above, and it never turns
    back: so it is the next level that way, from the start on, that is large or small enough, or else the last one.
    """
    least, most, last = int(target * low), int(target * high), len(THRESHOLDS) - 1
    levels = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda l: F.struct(l.cast("bigint").alias("level"), size(l).alias("n")))
    down = F.array_max(F.filter(levels, lambda x: (x["level"] <= start) & (x["n"] >= least)))["level"]
    up = F.array_min(F.filter(levels, lambda x: (x["level"] >= start) & (x["n"] <= most)))["level"]
    own = size(start)
    level = F.when(own < least, F.coalesce(down, F.lit(0))).when(own > most, F.coalesce(up, F.lit(last))).otherwise(start).cast("bigint")
    return F.struct(level.alias("level"), F.abs(level - start).cast("bigint").alias("retries"))


def running_xor(df: DataFrame, keys: list[str], order: str, value: str, block: int = 256) -> DataFrame:
    """``df`` with ``<value>_run``, the exclusive or of this and all earlier values of its keys.

    Two levels: inside blocks of ``block`` order numbers, and over the blocks' totals, so no window holds a whole key.
    """
    b = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_in", F.expr(f"bit_xor(`{value}`)").over(inside))
    total = b.groupBy(*keys, "_block").agg(F.expr(f"bit_xor(`{value}`)").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("_before", F.coalesce(F.expr("bit_xor(_t)").over(earlier), F.lit(0).cast("bigint"))).drop("_t")
    return b.join(total, [*keys, "_block"]).withColumn(f"{value}_run", F.col("_in").bitwiseXOR(F.col("_before"))).drop("_block", "_in", "_before")


def bracketed_level(size: Callable[[Column], Column], start: Column, target: int, low: float = 0.9, high: float = 1.025) -> Column:
    """(level, probes): where a search that strides and then halves ends, and all levels it has tried, in order.

    Sizes fall as levels rise. Outside the window the search strides away from ``start`` over 1, then 2, 4, 8 and 16 levels
    until a level is large or small enough, or the last is reached. Between that level and the one before it on the way it
    halves, and goes back to the best level if that was not the last one tried. The strides' places are known beforehand;
    only the halving is a fold, of as many steps as a level has bits.
    """
    least, most, last = int(target * low), int(target * high), len(THRESHOLDS) - 1
    strides = F.array(*[F.lit(v) for v in (1, 3, 7, 15, 31)])
    own = size(start)
    way = F.when(own > most, 1).when(own < least, -1).otherwise(0)
    good = lambda level: F.when(own > most, size(level) <= most).otherwise(size(level) >= least)
    within = lambda v: F.least(F.lit(last), F.greatest(F.lit(0), v)).cast("int")
    tried = F.array_distinct(F.transform(strides, lambda d: within(start + way * d)))
    places = F.transform(F.array(F.filter(tried, lambda v: v != start)), lambda t: F.struct(t.alias("t"), (F.array_position(F.transform(t, good), F.lit(True)) - 1).cast("int").alias("hit")))[0]

    def halved(p: Column) -> Column:
        hit = p["t"][p["hit"]]
        # on the near side of the hit lies the stride before it, or the start, which is next to it
        near = F.when(p["hit"] > 0, p["t"][p["hit"] - 1]).otherwise(hit - way)
        state = F.struct(hit.alias("best"), near.cast("int").alias("bad"), F.array(hit).alias("out"))

        def step(s: Column, _: Column) -> Column:
            gap = F.abs(s["best"] - s["bad"]) - 1
            at = (s["bad"] + way * (1 + F.floor((gap - 1) / 2))).cast("int")
            more = F.struct(F.when(good(at), at).otherwise(s["best"]).alias("best"), F.when(good(at), s["bad"]).otherwise(at).alias("bad"), F.concat(s["out"], F.array(at)).alias("out"))
            return F.when(gap > 0, more).otherwise(s)

        done = F.aggregate(F.sequence(F.lit(1), F.lit(last.bit_length())), state, step)
        back = F.transform(F.array(done), lambda s: F.struct(s["best"].alias("level"), F.concat(F.slice(p["t"], F.lit(1), p["hit"]), s["out"], F.when(F.element_at(s["out"], -1) != s["best"], F.array(s["best"])).otherwise(F.array().cast("array<int>"))).alias("more")))
        return back[0]

    def ended(p: Column) -> Column:
        none = F.struct(F.coalesce(F.try_element_at(p["t"], F.lit(-1)), start.cast("int")).alias("level"), p["t"].alias("more"))
        r = F.when((F.size(p["t"]) == 0) | (p["hit"] < 0), none).otherwise(halved(p))
        return F.struct(r["level"].cast("bigint").alias("level"), F.concat(F.array(start.cast("int")), r["more"]).alias("probes"))

    inside = F.struct(start.cast("bigint").alias("level"), F.array(start.cast("int")).alias("probes"))
    return F.when(way == 0, inside).otherwise(F.transform(F.array(places), ended)[0])
