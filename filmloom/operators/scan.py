"""Prefix scans of associative maps over ordered rows, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions import audio
from filmloom.sources.scratch import kept


def prefix_scan(rows: DataFrame, keys: list[str], order: str, state: Column, compose: Callable[[Column, Column], Column], identity: Column, out: str, fan: int = 64) -> DataFrame:
    """``rows`` with ``out``: the composition of ``state`` over all earlier rows with the same ``keys``; the first gets ``identity``.

    ``order`` is an integer from 0, unique within keys; gaps are no matter. Rows are taken ``fan`` neighbours at a time,
    their compositions as many again, and so on; then what comes before each group is handed down the same way. No task
    sees more than ``fan`` states of a group at once.
    """
    return rows.join(states_before(rows, keys, order, state, compose, identity, out, fan), [*keys, order])


def states_before(rows: DataFrame, keys: list[str], order: str, state: Column, compose: Callable[[Column, Column], Column], identity: Column, out: str, fan: int = 64) -> DataFrame:
    """Only the keys, ``order`` and ``out`` of ``prefix_scan``; ``rows`` are computed once."""
    kind = rows.select(state.alias("_s")).schema["_s"].dataType.simpleString()
    now, levels, most = rows.select(*keys, F.col(order).cast("bigint").alias("_o"), state.alias("_s")), [], 1
    while most:
        up = kept(now.groupBy(*keys, F.floor(F.col("_o") / fan).alias("_g")).agg(F.sort_array(F.collect_list(F.struct("_o", "_s"))).alias("_m")), "scan-states")
        levels.append(up)
        most = up.agg(F.max("_g")).first()[0] or 0
        now = up.select(*keys, F.col("_g").alias("_o"), F.aggregate("_m", identity, lambda a, x: compose(a, x["_s"])).alias("_s"))

    def handed(members: Column, before: Column) -> Column:
        start = F.struct(before.alias("a"), F.array().cast(f"array<struct<_o:bigint,_b:{kind}>>").alias("out"))
        one = lambda s, x: F.struct(compose(s["a"], x["_s"]).alias("a"), F.concat(s["out"], F.array(F.struct(x["_o"].alias("_o"), s["a"].alias("_b")))).alias("out"))
        return F.explode(F.aggregate(members, start, one, lambda s: s["out"]))

    down = levels[-1].select(*keys, handed(F.col("_m"), identity).alias("_x")).select(*keys, "_x.*")
    for level in reversed(levels[:-1]):
        # states take far more room than their files tell, so neither side is sent to every task
        got = level.hint("merge").join(down.withColumnRenamed("_o", "_g"), [*keys, "_g"])
        down = got.select(*keys, handed(F.col("_m"), F.col("_b")).alias("_x")).select(*keys, "_x.*")
    return down.select(*keys, F.col("_o").alias(order), F.col("_b").alias(out))


def adpcm_track(chunks: DataFrame, keys: list[str], order: str, codes: str, variant: str) -> DataFrame:
    """``chunks`` with step and sample, the state before each, and ``samples``; a track's first chunk starts from 0 and 0.

    Both parts of the state are sums held within bounds, so a chunk is a map of either that is known before its state is:
    step indices are scanned first, then, as they give every move, samples. Chunks are then decoded apart from each other.
    """
    a = prefix_scan(chunks, keys, order, audio.index_map(F.col(codes)), audio.clamp_then, audio.same(), "_i")
    a = a.withColumn("step", audio.clamped(F.col("_i"), F.lit(0).cast("bigint"))).drop("_i")
    b = prefix_scan(a, keys, order, audio.sample_map(F.col(codes), F.col("step"), variant), audio.clamp_then, audio.same(), "_p")
    b = b.withColumn("sample", audio.clamped(F.col("_p"), F.lit(0).cast("bigint"))).drop("_p")
    return b.withColumn("samples", audio.adpcm_decode(F.col(codes), audio.adpcm_state(F.col("sample"), F.col("step")), variant)["out"])
