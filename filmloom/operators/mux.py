"""Layout of muxed streams: which frames a sync point stands before, and where everything lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.operators.scan import prefix_scan
from filmloom.sources.scratch import kept

#: Fixed values of the format: bytes after which a sync point is due, flags of a frame and of a key frame, what is added to times.
DISTANCE, FLAGS, KEY, TIME_SHIFT = 65536, 4216, 1, 128
#: Bytes of a start code and of a checksum.
START, CHECK = 8, 4
#: Width in bytes of the ranges in which frames are looked up by their place.
RANGE = 4096


def varint_size(v: Column) -> Column:
    """Bytes of a number in groups of seven bits."""
    out = F.lit(1)
    for k in range(1, 9):
        out = F.when(v >= 1 << 7 * k, k + 1).otherwise(out)
    return out.cast("bigint")


def frame_size(stream: Column, time: Column, key: Column, size: Column) -> Column:
    """Bytes of a frame: its code, flags, stream, time and size, a checksum, and the data."""
    flags = F.lit(FLAGS).cast("bigint") + F.when(key, KEY).otherwise(0)
    return 1 + varint_size(flags) + varint_size(stream) + varint_size(time + TIME_SHIFT) + varint_size(size) + CHECK + size


def sync_size(stamp: Column, back_bytes: Column) -> Column:
    """Bytes of a sync point with a time stamp and a back pointer of ``back_bytes`` bytes."""
    body = varint_size(stamp) + back_bytes
    return START + varint_size(body + CHECK) + body + CHECK


def sync_points(frames: DataFrame, key: str, order: str, size: str, stamp: str, distance: int = DISTANCE) -> DataFrame:
    """The frames that a sync point stands before: key, ``order``, back, sync_bytes, before.

    A movie's first frame has one, and every frame before which ``distance`` bytes or more have been written since the
    beginning of the last. ``order`` counts a movie's frames from 0; ``size`` is a whole frame's bytes and ``stamp`` the time
    a sync point before it would carry. ``back`` is how far the last one lies back, in sixteens; ``before`` are the frames'
    bytes before this one, without sync points.

    Where the next sync point falls depends on this one's own size, and so on the size of its back pointer, of which there
    are few: with that, every frame knows the next one for each size. Chains of these are followed by doubling: whatever a
    movie's length, in as many rounds as its number of sync points has bits.
    """
    one = F.struct(F.col(size).cast("bigint").alias("n"))
    c = prefix_scan(frames.select(key, order, size, stamp), [key], order, one, lambda a, b: F.struct((a["n"] + b["n"]).alias("n")), F.struct(F.lit(0).cast("bigint").alias("n")), "_c")
    c = c.select(F.col(key).alias("m"), F.col(order).cast("bigint").alias("i"), F.col("_c.n").alias("c"), F.col(size).cast("bigint").alias("n"), F.col(stamp).alias("t"))
    c = kept(c, "mux-frames")
    last = c.agg(F.max("c").alias("c"), F.max("n").alias("n")).first()
    # back pointers between syncs are at least distance / 16; a frame can only be so large
    lengths = sorted({1, *range(_bytes(distance // 16), _bytes(((last["n"] or 0) + distance + 64) // 16) + 1)})
    nodes = c.select("m", "i", "c", "t", F.explode(F.array(*[F.lit(b).cast("bigint") for b in lengths])).alias("b")).where("b > 1 OR i = 0")
    nodes = nodes.withColumn("s", sync_size(F.col("t"), F.col("b"))).withColumn("due", F.col("c") + distance - F.col("s"))
    # the first frame whose beginning is at or behind what is due: due lies behind the beginning of the one before
    holds = c.select("m", (F.col("i") + 1).alias("j"), F.col("c").alias("low"), (F.col("c") + F.col("n")).alias("high"))
    holds = holds.select("*", F.explode(F.sequence(F.floor((F.col("low") + 1) / RANGE), F.floor(F.col("high") / RANGE))).alias("r"))
    to = nodes.withColumn("r", F.floor(F.col("due") / RANGE)).join(holds, ["m", "r"]).where("due > low AND due <= high")
    to = to.join(c.select("m", F.col("i").alias("j"), F.col("c").alias("c2")), ["m", "j"])
    back = F.floor((F.col("c2") - F.col("c") + F.col("s")) / 16)
    jump = to.select("m", F.col("i").alias("i0"), F.col("b").alias("b0"), F.col("j").alias("i1"), varint_size(back).alias("b1"))
    jump = kept(jump, "mux-jumps")
    tables, rounds = [jump], max(1, (last["c"] or 0) // distance + 1).bit_length()
    for _ in range(rounds - 1):
        half = tables[-1]
        twice = half.join(half.select("m", F.col("i0").alias("i1"), F.col("b0").alias("b1"), F.col("i1").alias("i2"), F.col("b1").alias("b2")), ["m", "i1", "b1"])
        tables.append(kept(twice.select("m", "i0", "b0", F.col("i2").alias("i1"), F.col("b2").alias("b1")), "mux-jumps"))
    reached = c.where("i = 0").select("m", F.lit(0).cast("bigint").alias("i0"), F.lit(1).cast("bigint").alias("b0"))
    for table in reversed(tables):
        reached = kept(reached.union(reached.join(table, ["m", "i0", "b0"]).select("m", "i1", "b1")), "mux-reached")
    at = reached.join(nodes.select("m", F.col("i").alias("i0"), F.col("b").alias("b0"), "c", "s"), ["m", "i0", "b0"])
    # how far back: from a sync point to the one before it
    arrived = jump.join(at.select("m", "i0", "b0", F.col("c").alias("c0"), F.col("s").alias("s0")), ["m", "i0", "b0"]).select("m", F.col("i1").alias("i0"), "c0", "s0")
    at = at.join(arrived, ["m", "i0"], "left")
    back = F.coalesce(F.floor((F.col("c") - F.col("c0") + F.col("s0")) / 16), F.lit(0)).cast("bigint")
    return at.select(F.col("m").alias(key), F.col("i0").alias(order), back.alias("back"), F.col("s").alias("sync_bytes"), F.col("c").alias("before"))


def _bytes(v: int) -> int:
    return max(1, -(-v.bit_length() // 7))


def layout(frames: DataFrame, syncs: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """``frames`` with ``synced`` and ``at``, where each begins behind the headers, after its sync point if it has one."""
    f = frames.join(syncs.select(key, order, "sync_bytes"), [key, order], "left")
    own = F.struct((F.col(size) + F.coalesce("sync_bytes", F.lit(0))).cast("bigint").alias("n"))
    f = prefix_scan(f, [key], order, own, lambda a, b: F.struct((a["n"] + b["n"]).alias("n")), F.struct(F.lit(0).cast("bigint").alias("n")), "_at")
    return f.withColumn("synced", F.col("sync_bytes").isNotNull()).withColumn("at", F.col("_at.n") + F.coalesce("sync_bytes", F.lit(0))).drop("_at", "sync_bytes")
