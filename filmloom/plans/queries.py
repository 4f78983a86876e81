"""The engine's own queries: importing this module fills the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.plans.registry import query, table


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 luma pictures (frame_no, x, y, luma 0..63) from the embedding vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return v.select(
        F.col("vec_id").alias("frame_no"),
        (F.col("p") % 8).cast("bigint").alias("x"),
        F.floor(F.col("p") / 8).cast("bigint").alias("y"),
        F.greatest(F.lit(0), F.least(F.lit(63), F.floor((F.col("v").cast("double") + 1.0) * 32.0))).cast("bigint").alias("luma"),
    )


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pictures whole: frame_no and luma, an array of 64."""
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(63), F.floor((v.cast("double") + 1.0) * 32.0))).cast("bigint")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), F.transform("embedding", level).alias("luma"))


FRAMES_SQL = """frames AS (SELECT vec_id AS frame_no, CAST(p % 8 AS BIGINT) AS x, CAST(p // 8 AS BIGINT) AS y,
  CAST(greatest(0, least(63, floor((CAST(v AS DOUBLE) + 1.0) * 32.0))) AS BIGINT) AS luma
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM embeddings))"""


@query(
    "frame_delta_metrics",
    f"""WITH {FRAMES_SQL}
SELECT c.frame_no, CAST(count(*) AS BIGINT) AS n, CAST(sum((c.luma - p.luma) * (c.luma - p.luma)) AS BIGINT) AS sse,
  CAST(max(abs(c.luma - p.luma)) AS BIGINT) AS max_err
FROM frames c JOIN frames p ON p.frame_no + 1 = c.frame_no AND p.x = c.x AND p.y = c.y GROUP BY c.frame_no""",
)
def frame_delta_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error and largest error of every picture against the one before it."""
    from filmloom.operators.pictures import error_sums, with_previous

    sse, most = error_sums(F.col("luma"), F.col("prev_luma"))
    return with_previous(pictures(spark, sf_dir), ["luma"]).select("frame_no", F.size("luma").cast("bigint").alias("n"), sse.alias("sse"), most.alias("max_err"))


MOTION_SQL = f"""WITH {FRAMES_SQL},
v AS (SELECT row_number() OVER (ORDER BY least(4, greatest(abs(dx), abs(dy))), dy, dx) - 1 AS ord, dx, dy FROM (SELECT unnest(range(-8, 9)) AS dx) a, (SELECT unnest(range(-8, 9)) AS dy) b WHERE dx <> 0 OR dy <> 0),
m AS (SELECT c.frame_no, c.x // 4 AS bx, c.y // 4 AS brow, ord, dx, dy, CAST(sum(abs(c.luma - p.luma)) AS BIGINT) AS err
  FROM frames c CROSS JOIN v JOIN frames p ON p.frame_no + 1 = c.frame_no AND p.x = c.x + dx AND p.y = c.y + dy
  WHERE (c.x // 4) * 4 + dx >= 0 AND (c.x // 4) * 4 + dx + 4 <= 8 AND (c.y // 4) * 4 + dy >= 0 AND (c.y // 4) * 4 + dy + 4 <= 8
  GROUP BY ALL),
best AS (SELECT frame_no, CAST(bx AS BIGINT) AS bx, CAST(brow AS BIGINT) AS brow, err, CAST(ord AS BIGINT) AS ord, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy
  FROM (SELECT *, row_number() OVER (PARTITION BY frame_no, bx, brow ORDER BY err, ord) AS rn FROM m) WHERE rn = 1)
"""


@query("block_motion_search", MOTION_SQL + "SELECT * FROM best")
def block_motion_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all 288 temporal vectors of every 4x4 block, by luma."""
    from filmloom.operators.pictures import best_vectors, with_previous

    return best_vectors(with_previous(pictures(spark, sf_dir), ["luma"]), ["luma"])


@query(
    "motion_statistics",
    MOTION_SQL + "SELECT frame_no, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(abs(dx) + abs(dy)) AS BIGINT) AS reach, CAST(max(abs(dx)) AS BIGINT) AS max_dx, CAST(max(abs(dy)) AS BIGINT) AS max_dy FROM best GROUP BY frame_no",
)
def motion_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the best vectors of a picture reach."""
    b = block_motion_search(spark, sf_dir)
    return b.groupBy("frame_no").agg(
        F.count("*").alias("blocks"), F.sum(F.abs("dx") + F.abs("dy")).alias("reach"), F.max(F.abs("dx")).alias("max_dx"), F.max(F.abs("dy")).alias("max_dy")
    )


DELTA_SQL = f"""WITH {FRAMES_SQL}, d AS (SELECT c.frame_no, c.x, c.y, c.luma - p.luma AS d
FROM frames c JOIN frames p ON p.frame_no + 1 = c.frame_no AND p.x = c.x AND p.y = c.y)
"""


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filmloom.operators.pictures import with_previous

    # whole pictures are joined, a row each, and pixels made of them afterwards
    both = with_previous(pictures(spark, sf_dir), ["luma"])
    d = both.select("frame_no", F.posexplode(F.zip_with("luma", "prev_luma", lambda a, b: a - b)).alias("p", "d"))
    return d.select("frame_no", (F.col("p") % 8).cast("bigint").alias("x"), F.floor(F.col("p") / 8).cast("bigint").alias("y"), "d")


def psnr(sse, n, peak: float):
    """10 log10(peak^2 / MSE); infinite without an error, NaN without samples."""
    return F.when(n == 0, F.lit(float("nan"))).when(sse == 0, F.lit(float("inf"))).otherwise(F.round(10 * F.log10(peak * peak * n / sse), 6))


_PSNR = "CASE WHEN sum(d * d) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(10 * log10(3969.0 * count(*) / sum(d * d)), 6) END"


@query("frame_psnr", DELTA_SQL + f"SELECT frame_no, {_PSNR} AS psnr FROM d GROUP BY frame_no")
def frame_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak signal-to-noise ratio of every picture against the one before it, peak 63."""
    g = deltas(spark, sf_dir).groupBy("frame_no").agg(F.sum(F.col("d") * F.col("d")).alias("sse"), F.count("*").alias("n"))
    return g.select("frame_no", psnr(F.col("sse"), F.col("n"), 63.0).alias("psnr"))


@query(
    "sequence_totals",
    DELTA_SQL + f"SELECT CAST(count(DISTINCT frame_no) AS BIGINT) AS frames, CAST(sum(d * d) AS BIGINT) AS sse, CAST(max(abs(d)) AS BIGINT) AS max_err, {_PSNR} AS psnr FROM d",
)
def sequence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all pictures: errors add up, and the ratio comes from their sum, never from a mean of ratios."""
    per = deltas(spark, sf_dir).groupBy("frame_no").agg(F.sum(F.col("d") * F.col("d")).alias("s"), F.max(F.abs("d")).alias("m"), F.count("*").alias("n"))
    g = per.agg(F.count("*").alias("frames"), F.sum("s").alias("sse"), F.max("m").alias("max_err"), F.sum("n").alias("n"))
    return g.select("frames", "sse", "max_err", psnr(F.col("sse"), F.col("n"), 63.0).alias("psnr"))


_OVER = ", ".join(f"CAST(count(*) FILTER (abs(d) > {k}) AS BIGINT) AS over_{k}" for k in range(7))


@query(
    "copy_quality_profile",
    DELTA_SQL + f"SELECT frame_no, CAST(x // 4 AS BIGINT) AS bx, CAST(y // 4 AS BIGINT) AS brow, CAST(sum(abs(d)) AS BIGINT) AS total, CAST(max(abs(d)) AS BIGINT) AS most, {_OVER} FROM d GROUP BY ALL",
)
def copy_quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stationary 4x4 block the summed and largest luma error and how many pixels exceed each of seven errors."""
    a = F.abs("d")
    return deltas(spark, sf_dir).groupBy("frame_no", F.floor(F.col("x") / 4).alias("bx"), F.floor(F.col("y") / 4).alias("brow")).agg(
        F.sum(a).alias("total"), F.max(a).alias("most"), *[F.count_if(a > k).alias(f"over_{k}") for k in range(7)]
    )


@query(
    "luma_residuals",
    f"""WITH {FRAMES_SQL}, b AS (SELECT *, x // 4 AS bx, y // 4 AS brow, x % 4 AS ix, y % 4 AS iy FROM frames),
m AS (SELECT frame_no, bx, brow, sum(luma) // 16 AS mean FROM b GROUP BY ALL),
c AS (SELECT frame_no, bx, brow, coalesce(lag(mean) OVER (PARTITION BY frame_no ORDER BY brow, bx), 0) AS carried FROM m),
n AS (SELECT b.*, lag(luma) OVER (PARTITION BY frame_no, bx, brow, iy ORDER BY ix) AS l, lag(luma) OVER (PARTITION BY frame_no, bx, brow, ix ORDER BY iy) AS a FROM b)
SELECT n.frame_no, n.x, n.y, CAST((luma - CASE WHEN l IS NULL AND a IS NULL THEN carried WHEN a IS NULL THEN l WHEN l IS NULL THEN a ELSE (l + a) // 2 END + 64) % 64 AS BIGINT) AS residual
FROM n JOIN c USING (frame_no, bx, brow)""",
)
def luma_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction residuals mod 64 of 4x4 blocks: from left and above, the first pixel from the last block's mean. One expression a picture."""
    p = pictures(spark, sf_dir)
    at = lambda x, y: F.get("luma", (y * 8 + x).cast("int"))
    mean = lambda k: F.floor(F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: at(k % 2 * 4 + i % 4, F.floor(k / 2) * 4 + F.floor(i / 4))), F.lit(0).cast("bigint"), lambda a, v: a + v) / 16)
    # what is carried to each of the four blocks
    p = p.withColumn("carried", F.array(F.lit(0).cast("bigint"), *[mean(F.lit(k)).cast("bigint") for k in range(3)]))

    def residual(v: Column, i: Column) -> Column:
        x, y = i % 8, F.floor(i / 8)
        left, above = at(x - 1, y), at(x, y - 1)
        first = F.get("carried", (F.floor(y / 4) * 2 + F.floor(x / 4)).cast("int"))
        guess = F.when((x % 4 == 0) & (y % 4 == 0), first).when(y % 4 == 0, left).when(x % 4 == 0, above).otherwise(F.floor((left + above) / 2))
        return F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), ((v - guess + 64) % 64).cast("bigint").alias("residual"))

    return p.select("frame_no", F.explode(F.transform("luma", residual)).alias("r")).select("frame_no", "r.*")


RGB_SQL = "rgb AS (SELECT event_id, (user_id * 37 + event_id * 11) & 255 AS r, CAST(floor(value) AS BIGINT) & 255 AS g, (event_id * 73) & 255 AS b FROM events)"


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda c: c.bitwiseAND(F.lit(255))
    return table(spark, sf_dir, "events").select(
        "event_id", byte(F.col("user_id") * 37 + F.col("event_id") * 11).alias("r"), byte(F.floor("value").cast("bigint")).alias("g"), byte(F.col("event_id") * 73).alias("b")
    )


@query(
    "rgb555_round_trip",
    f"""WITH {RGB_SQL} SELECT event_id, (r >> 3) | ((g >> 3) << 5) | ((b >> 3) << 10) AS word,
((r >> 3) << 3) | (r >> 5) AS r8, ((g >> 3) << 3) | (g >> 5) AS g8, ((b >> 3) << 3) | (b >> 5) AS b8 FROM rgb""",
)
def rgb555_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24-bit colours packed into 15 bits, red low, and widened again."""
    from filmloom.functions.colour import rgb555, widen5

    p = rgb(spark, sf_dir).withColumn("word", rgb555(F.col("r"), F.col("g"), F.col("b")))
    part = lambda at: F.shiftright("word", at).bitwiseAND(F.lit(31))
    return p.select("event_id", "word", widen5(part(0)).alias("r8"), widen5(part(5)).alias("g8"), widen5(part(10)).alias("b8"))


PCM_SQL = "pcm AS (SELECT user_id, event_id, CAST(greatest(-32768, least(32767, floor((value - 245.0) * 128.0))) AS BIGINT) AS s16 FROM events)"


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor((F.col("value") - 245.0) * 128.0)))
    return table(spark, sf_dir, "events").select("user_id", "event_id", s.cast("bigint").alias("s16"))


@query(
    "audio_snr",
    f"WITH {PCM_SQL} SELECT user_id, CAST(count(*) AS BIGINT) AS n, CASE WHEN sum((s16 & 255) * (s16 & 255)) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(10 * log10(CAST(sum(s16 * s16) AS DOUBLE) / CAST(sum((s16 & 255) * (s16 & 255)) AS DOUBLE)), 6) END AS snr FROM pcm GROUP BY user_id",
)
def audio_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track the signal-to-noise ratio of eight-bit samples against the sixteen-bit ones."""
    from filmloom.functions.audio import s8_of_s16, s16_of_s8

    e = F.col("s16") - s16_of_s8(s8_of_s16(F.col("s16")))
    g = pcm(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("s16") * F.col("s16")).alias("p"), F.sum(e * e).alias("q"))
    return g.select("user_id", "n", F.when(F.col("q") == 0, float("inf")).otherwise(F.round(10 * F.log10(F.col("p").cast("double") / F.col("q").cast("double")), 6)).alias("snr"))


@query(
    "alaw_expand",
    """WITH a AS (SELECT event_id, xor(CAST(floor(value * 7) AS BIGINT) & 255, 85) AS a FROM events), s AS (SELECT event_id, a, (a & 112) >> 4 AS seg, (a & 15) << 4 AS base FROM a),
t AS (SELECT event_id, a, CASE WHEN seg = 0 THEN base + 8 ELSE (base + 264) << greatest(seg - 1, 0) END AS t FROM s)
SELECT event_id, CAST(CASE WHEN a & 128 <> 0 THEN t ELSE -t END AS BIGINT) AS s16 FROM t""",
)
def alaw_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-law bytes to sixteen-bit samples."""
    from filmloom.functions.audio import alaw_to_s16

    return table(spark, sf_dir, "events").select("event_id", alaw_to_s16(F.floor(F.col("value") * 7).cast("bigint").bitwiseAND(F.lit(255))).cast("bigint").alias("s16"))


CHUNKS_SQL = """z AS (SELECT conv_id, turn, strlen(text) AS sz FROM conversations),
c AS (SELECT conv_id, turn, CAST(sz AS BIGINT) AS sz, CAST(2048 + coalesce(sum((sz + 2047) // 2048 * 2048) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM z)"""


@query("chunk_layout", f"WITH {CHUNKS_SQL} SELECT * FROM c")
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector-aligned offsets of a movie's chunks behind a header of one sector."""
    from pyspark.sql import Window

    from filmloom.functions.bits import align_up

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("bigint").alias("sz"))
    return c.withColumn("off", 2048 + F.coalesce(F.sum(align_up(F.col("sz"), 2048)).over(before), F.lit(0)))


@query(
    "chunk_maxima",
    f"WITH {CHUNKS_SQL} SELECT conv_id, CAST(coalesce(max(sz + 1) FILTER (turn % 2 = 0 AND sz > 0), 0) AS BIGINT) AS even_max, CAST(coalesce(max(sz + 1) FILTER (turn % 2 = 1 AND sz > 0), 0) AS BIGINT) AS odd_max FROM c GROUP BY conv_id",
)
def chunk_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffer sizes: the largest even and odd chunk of a movie, plus one where there is any."""
    size = lambda odd: F.coalesce(F.max(F.when((F.col("turn") % 2 == odd) & (F.col("sz") > 0), F.col("sz") + 1)), F.lit(0))
    return chunk_layout(spark, sf_dir).groupBy("conv_id").agg(size(0).alias("even_max"), size(1).alias("odd_max"))


@query(
    "frame_chunks",
    "SELECT chunk_no, CAST(count(*) AS BIGINT) AS frames, CAST(min(f) AS BIGINT) AS first_frame FROM (SELECT f, CAST(ceil((f + 1) / 12.5) - 1 AS BIGINT) AS chunk_no FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS f FROM embeddings)) GROUP BY chunk_no",
)
def frame_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames dealt to chunks of one second at 12.5 frames a second: chunk i ends at frame floor((i + 1) 12.5).

    The frame's rank comes from a distributed count of the frames before it, in blocks of 2^20 ids.
    """
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / (1 << 20)).alias("block"))
    blocks = e.groupBy("block").agg(F.count("*").alias("n"))
    base = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    f = e.join(base, "block").select((F.col("base") + F.row_number().over(Window.partitionBy("block").orderBy("vec_id")) - 1).alias("f"))
    chunk = (F.ceil((F.col("f") + 1) / 12.5) - 1).cast("bigint")
    return f.groupBy(chunk.alias("chunk_no")).agg(F.count("*").alias("frames"), F.min("f").alias("first_frame"))


@query(
    "frame_rates",
    """WITH d AS (SELECT event_id, value - 20 AS fps, greatest(1, CAST(floor((value - 20) * 1000 + 0.5) AS BIGINT)) AS d FROM events)
SELECT event_id, CASE WHEN fps > 0 THEN 1000 // gcd(1000, d) ELSE 1 END AS num, CASE WHEN fps > 0 THEN d // gcd(1000, d) ELSE 25 END AS den FROM d""",
)
def frame_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time bases of frame rates, in thousandths, reduced by Euclid's algorithm in a fold; a rate that is not positive counts as 25."""
    fps = F.col("value") - 20
    n = F.greatest(F.lit(1).cast("bigint"), F.floor(fps * 1000 + 0.5).cast("bigint"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % F.greatest(s["b"], F.lit(1))).cast("bigint").alias("b"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.struct(n.alias("a"), F.lit(1000).cast("bigint").alias("b")), step)["a"]
    e = table(spark, sf_dir, "events").select("event_id", fps.alias("fps"), n.alias("d"), gcd.alias("g"))
    own = lambda x, other: F.when(F.col("fps") > 0, F.floor(x / F.col("g"))).otherwise(F.lit(other)).cast("bigint")
    return e.select("event_id", own(F.lit(1000), 1).alias("num"), own(F.col("d"), 25).alias("den"))


@query(
    "varints",
    """WITH v AS (SELECT event_id, event_id * 97 AS v FROM events)
SELECT event_id, CASE WHEN v < 128 THEN '' WHEN v < 16384 THEN printf('%02X', (v >> 7) + 128) WHEN v < 2097152 THEN printf('%02X%02X', (v >> 14) + 128, ((v >> 7) & 127) + 128)
  ELSE printf('%02X%02X%02X', (v >> 21) + 128, ((v >> 14) & 127) + 128, ((v >> 7) & 127) + 128) END || printf('%02X', v & 127) AS bytes FROM v""",
)
def varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable-length integers of a muxed stream."""
    from filmloom.functions.bits import varint_hex

    return table(spark, sf_dir, "events").select("event_id", varint_hex(F.col("event_id") * 97).alias("bytes"))


@query(
    "presentation_times",
    "SELECT user_id, event_id, CAST((SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.event_id < a.event_id) AS BIGINT) AS pts FROM events a",
)
def presentation_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick a frame within a stream."""
    from pyspark.sql import Window

    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint").alias("pts"))
