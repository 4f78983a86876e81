"""Queries of reports, labels, checks and small files; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filmloom.functions import bits, colour
from filmloom.operators import codes
from filmloom.operators.pictures import error_sums
from filmloom.plans.media import LUMA_BITS
from filmloom.plans.pictures import YUV, YUV_SQL, coloured, coloured_pairs
from filmloom.plans.queries import PCM_SQL, RGB_SQL, luma_residuals, pcm, rgb
from filmloom.plans.registry import ORACLES, query, table

_DIFF_SQL = "d AS (SELECT c.frame_no, c.y - p.y AS dy, c.u - p.u AS du, c.v - p.v AS dv FROM yuv c JOIN yuv p ON p.frame_no + 1 = c.frame_no AND p.x = c.x AND p.row_no = c.row_no)"


def _psnr_sql(plane: str, peak: int) -> str:
    sse = f"sum(d{plane} * d{plane})"
    return f"CASE WHEN {sse} = 0 THEN CAST('Infinity' AS DOUBLE) ELSE round(10 * log10({peak * peak}.0 * count(*) / {sse}), 6) END AS psnr_{plane}"


@query(
    "verify_totals",
    f"""WITH {YUV_SQL}, {_DIFF_SQL}, b AS (SELECT (SELECT count(DISTINCT frame_no) FROM d) AS frames)
SELECT frame_no % 4 AS report, CAST(count(DISTINCT frame_no) AS BIGINT) AS frames, CAST(count(*) AS BIGINT) AS pixels, CAST(sum(CASE WHEN dy = dy THEN 1 END) // 64 * 20 + sum(frame_no % 7) // 64 AS BIGINT) AS payload_bytes,
 {", ".join(f"CAST(sum(d{p} * d{p}) AS BIGINT) AS sse_{p}, CAST(max(abs(d{p})) AS BIGINT) AS max_error_{p}" for p in YUV)}, {_psnr_sql("y", 63)}, {_psnr_sql("u", 31)}, {_psnr_sql("v", 31)} FROM d GROUP BY frame_no % 4""",
)
def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of reports in lines of name=value, read back from text: sums over frames, largest errors, ratios from the sums.

    The lines are those of the pictures' differences, three a frame, four reports in all.
    """
    p = coloured_pairs(spark, sf_dir)
    said = []
    for plane in YUV:
        sse, most = error_sums(F.col(plane), F.col(f"prev_{plane}"))
        said += [F.concat(F.lit(f"sse_{plane}="), sse.cast("string")), F.concat(F.lit(f"max_error_{plane}="), most.cast("string"))]
    lines = F.array(
        F.concat(F.lit("codec=19 frame="), F.col("frame_no").cast("string"), F.lit(" size=8x8")), F.concat_ws(" ", F.lit("reference=exact"), *said), F.concat(F.lit("summary payload_bytes="), (20 + F.col("frame_no") % 7).cast("string"))
    )
    return report_totals(p.select((F.col("frame_no") % 4).alias("report"), F.explode(lines).alias("line")), "report", "line")


def report_totals(lines: DataFrame, report: str, line: str) -> DataFrame:
    """Per report the totals of its lines; a line's kind is what it begins with, fields are name=value, parts without = are passed over."""
    at = F.str_to_map(F.col(line), F.lit(" "), F.lit("="))
    own = lines.select(report, F.col(line).alias("_l"), at.alias("_f"))
    number = lambda name: F.col("_f")[name].try_cast("bigint")
    size = F.split(F.col("_f")["size"], "x")
    kind = lambda start: F.col("_l").startswith(start)
    sums = [F.sum(F.when(kind("reference="), number(f"sse_{p}"))).alias(f"sse_{p}") for p in YUV]
    most = [F.max(F.when(kind("reference="), number(f"max_error_{p}"))).alias(f"max_error_{p}") for p in YUV]
    g = own.groupBy(report).agg(
        F.count_if(kind("codec=")).alias("frames"), F.sum(F.when(kind("codec="), size[0].try_cast("bigint") * size[1].try_cast("bigint"))).alias("pixels"), F.sum(F.when(kind("summary "), number("payload_bytes"))).alias("payload_bytes"), *sums, *most
    )
    ratio = lambda p, peak: F.when(F.col(f"sse_{p}") == 0, float("inf")).otherwise(F.round(10 * F.log10(float(peak * peak) * F.col("pixels") / F.col(f"sse_{p}")), 6)).alias(f"psnr_{p}")
    return g.select("*", ratio("y", 63), ratio("u", 31), ratio("v", 31))


@query(
    "quality_points",
    f"""WITH {RGB_SQL}, e AS (SELECT event_id % 5 AS series, CASE WHEN event_id % 5 = 0 THEN 0 ELSE r - (((r >> 3) << 3) | (r >> 5)) END AS dr, CASE WHEN event_id % 5 = 0 THEN 0 ELSE g - (((g >> 3) << 3) | (g >> 5)) END AS dg,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE b - (((b >> 3) << 3) | (b >> 5)) END AS db FROM rgb),
m AS (SELECT series, CAST(count(*) AS BIGINT) AS pixels, CAST(sum(dr * dr + dg * dg + db * db) AS DOUBLE) / CAST(3 * count(*) AS DOUBLE) AS mse, CAST(count(*) AS DOUBLE) / 64 * 12.5 * 8 / 1000 AS kbit FROM e GROUP BY series)
SELECT series, pixels, CASE WHEN mse = 0 THEN 99.0 ELSE round(10 * log10(255.0 * 255.0 / mse), 6) END AS psnr, round(kbit, 6) AS kbit_s, CAST(row_number() OVER (ORDER BY kbit, series) AS BIGINT) AS place FROM m""",
)
def quality_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and quality of series of colours kept in 15 bits, one of them exactly: 99 where there is no error, in order of rate. One row a series."""
    c = rgb(spark, sf_dir).withColumn("series", F.col("event_id") % 5)
    kept = lambda x: colour.widen5(F.shiftright(x, 3))
    d = lambda n: F.when(F.col("series") == 0, 0).otherwise(F.col(n) - kept(F.col(n)))
    g = c.groupBy("series").agg(F.count("*").alias("pixels"), F.sum(d("r") * d("r") + d("g") * d("g") + d("b") * d("b")).alias("sse"))
    mse = F.col("sse").cast("double") / (3 * F.col("pixels")).cast("double")
    rate = F.col("pixels").cast("double") / 64 * 12.5 * 8 / 1000
    psnr = F.when(F.col("sse") == 0, 99.0).otherwise(F.round(10 * F.log10(255.0 * 255.0 / mse), 6))
    return g.select("series", "pixels", psnr.alias("psnr"), F.round(rate, 6).alias("kbit_s"), F.row_number().over(Window.orderBy(rate, "series")).cast("bigint").alias("place"))


_LABELS = ["6Y5UV 6,5,5", "packed 6y6uv", "YUV 8,8,8", "yuv 5,5,5", "rgb", "RGB 8,8,8", "8 palette 4096", "Palette 70000 bytes", "", "no colours"]


def label_of(i: Column) -> Column:
    return F.array(*map(F.lit, _LABELS))[i.cast("int")]


_LABEL_SQL = "[" + ", ".join(f"'{x}'" for x in _LABELS) + "]"


@query(
    "colour_labels",
    f"""WITH l AS (SELECT p_partkey, ({_LABEL_SQL})[p_partkey % 10 + 1] AS label, CASE WHEN p_size % 2 = 0 THEN 24 ELSE 16 END AS depth FROM part)
SELECT p_partkey, CASE WHEN contains(upper(label), '6Y5UV') THEN '6y5uv' WHEN contains(upper(label), '6Y6UV') THEN '6y6uv' WHEN contains(upper(label), 'YUV') THEN CASE WHEN depth = 24 THEN 'yuv888' ELSE 'yuv555' END
  WHEN depth = 24 THEN 'rgb888' ELSE 'rgb555' END AS colour, CASE WHEN coalesce(TRY_CAST(nullif(regexp_extract(lower(label), 'palette +([0-9]+)', 1), '') AS BIGINT), 65536) + 768 <= 65536 THEN TRY_CAST(regexp_extract(lower(label), 'palette +([0-9]+)', 1) AS BIGINT) END AS palette_at FROM l""",
)
def colour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A movie's colour model from its label, in either case, by priority and depth; and where its palette is, if that fits a file of 64 KB."""
    p = table(spark, sf_dir, "part").select("p_partkey", label_of(F.col("p_partkey") % 10).alias("label"), (F.col("p_size") % 2 == 0).alias("deep"))
    has = lambda t: F.contains(F.upper("label"), F.lit(t))
    model = F.when(has("6Y5UV"), "6y5uv").when(has("6Y6UV"), "6y6uv").when(has("YUV"), F.when(F.col("deep"), "yuv888").otherwise("yuv555")).otherwise(F.when(F.col("deep"), "rgb888").otherwise("rgb555"))
    at = F.regexp_extract(F.lower("label"), "palette +([0-9]+)", 1).try_cast("bigint")
    return p.select("p_partkey", model.alias("colour"), F.when(at + 768 <= 65536, at).alias("palette_at"))


@query(
    "picture_dimensions",
    """WITH d AS (SELECT p_partkey, p_size * 7 AS w, p_partkey % 97 AS h, (['blocks', '124', 'lines', '130', '23'])[p_partkey % 5 + 1] AS codec, p_partkey % 9 * p_size AS b FROM part),
v AS (SELECT *, CASE codec WHEN 'blocks' THEN 4 WHEN '124' THEN 8 WHEN '130' THEN 2 WHEN '23' THEN 2 ELSE 1 END AS unit, CASE WHEN b IN (1, 2, 4, 8, 16, 32, 64) THEN b ELSE 1 END AS block FROM d)
SELECT p_partkey, w > 0 AND h > 0 AND w % unit = 0 AND (codec = '23' OR h % unit = 0) AS fits, CAST((w + block - 1) // block * block AS BIGINT) AS width, CAST((h + block - 1) // block * block AS BIGINT) AS height FROM v""",
)
def picture_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a codec takes a picture's size, and the size rounded up to whole blocks; a block side that is no power of two up to 64 counts as one."""
    p = table(spark, sf_dir, "part")
    d = p.select("p_partkey", (F.col("p_size") * 7).cast("bigint").alias("w"), (F.col("p_partkey") % 97).cast("bigint").alias("h"), (F.col("p_partkey") % 5).alias("k"), (F.col("p_partkey") % 9 * F.col("p_size")).cast("bigint").alias("b"))
    unit = F.array(*map(F.lit, (4, 8, 1, 2, 2)))[F.col("k").cast("int")]
    block = F.when((F.col("b") >= 1) & (F.col("b") <= 64) & (F.bit_count(F.col("b")) == 1), F.col("b")).otherwise(1)
    fits = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("w") % unit == 0) & ((F.col("k") == 4) | (F.col("h") % unit == 0))
    up = lambda n: (F.floor((n + block - 1) / block) * block).cast("bigint")
    return d.select("p_partkey", fits.alias("fits"), up(F.col("w")).alias("width"), up(F.col("h")).alias("height"))


@query(
    "movie_frame_counts",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 11 = 5 THEN strlen(text) ELSE strlen(text) // 32 * 32 END AS n FROM conversations)
SELECT conv_id, CASE WHEN bool_and(n % 32 = 0 AND n // 32 <= 100) THEN CAST(sum(n // 32) AS BIGINT) END AS frames, bool_and(n % 32 = 0) AS whole FROM c GROUP BY conv_id""",
)
def movie_frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of movies with 32 bytes a frame and at most 100 frames a chunk; null where a chunk holds a part of a frame or too many."""
    n = F.octet_length("text").cast("bigint")
    c = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("turn") % 11 == 5, n).otherwise(F.floor(n / 32) * 32).alias("n"))
    frames, whole = F.floor(F.col("n") / 32), F.col("n") % 32 == 0
    g = c.groupBy("conv_id").agg(F.sum(frames).alias("frames"), F.bool_and(whole & (frames <= 100)).alias("ok"), F.bool_and(whole).alias("whole"))
    return g.select("conv_id", F.when(F.col("ok"), F.col("frames")).alias("frames"), "whole")


_LE = "printf('%02X%02X%02X%02X', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"


@query(
    "wav_files",
    f"""WITH {PCM_SQL}, t AS (SELECT user_id, CAST(2 * count(*) AS BIGINT) AS n, CAST(sum(s16) AS BIGINT) AS total FROM pcm GROUP BY user_id)
SELECT user_id, '52494646' || {_LE.format("(36 + n)")} || '57415645666D74201000000001000100112B0000225600000200100064617461' || {_LE.format("n")} AS header, n AS data_bytes, total FROM t""",
)
def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as sound files of 11025 samples a second: the header, the size of the data, and the sum of the samples in it.

    A track's data stays in rows, one a sample; the header needs only their number.
    """
    t = pcm(spark, sf_dir).groupBy("user_id").agg((2 * F.count("*")).alias("n"), F.sum("s16").alias("total"))
    return t.select("user_id", F.hex(bits.wav_header(F.col("n"), 11025, 1)).alias("header"), F.col("n").alias("data_bytes"), "total")


@query(
    "prefix_codes",
    f"""WITH r AS ({ORACLES['luma_residuals']}) SELECT frame_no, CAST(x // 4 AS BIGINT) AS bx, CAST(y // 4 AS BIGINT) AS brow, CAST(sum(({LUMA_BITS})[residual + 1]) AS BIGINT) AS bits,
 string_agg(CAST(residual AS VARCHAR), ',' ORDER BY y, x) AS symbols FROM r GROUP BY ALL""",
)
def prefix_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of a block written as prefix codes and read back: the bits they take and the symbols found.

    Codes are the canonical ones of the fixed lengths, checked to be free of prefixes of each other.
    """
    own = codes.canonical(LUMA_BITS)
    codes.check(own)
    r = luma_residuals(spark, sf_dir).select("frame_no", F.floor(F.col("x") / 4).alias("bx"), F.floor(F.col("y") / 4).alias("brow"), "y", "x", "residual")
    b = r.groupBy("frame_no", "bx", "brow").agg(F.array_sort(F.collect_list(F.struct("y", "x", "residual"))).alias("s"))  # sixteen a block
    b = b.withColumn("written", codes.written(F.col("s.residual"), own))
    return b.select("frame_no", "bx", "brow", F.length("written").cast("bigint").alias("bits"), F.array_join(codes.read(F.col("written"), own), ",").alias("symbols"))


@query(
    "picture_files",
    f"""WITH {YUV_SQL}, s AS (SELECT frame_no, row_no * 8 + x AS k, CAST(sign(y * 255) * floor((y * 255 + 31) / 63) AS BIGINT) AS g FROM yuv)
SELECT frame_no, md5(unhex('50360A3820380A3235350A' || string_agg(printf('%02X%02X%02X', g, g, g), '' ORDER BY k))) AS md5, CAST(11 + 3 * count(*) AS BIGINT) AS size FROM s GROUP BY frame_no""",
)
def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures as grey portable pixmaps: size and checksum of each file's bytes."""
    level = lambda y: F.floor((y * 255 + 31) / 63)
    two = lambda n: F.lpad(F.hex(n), 2, "0")
    body = F.array_join(F.transform("y", lambda y: F.repeat(two(level(y)), F.lit(3))), "")
    c = coloured(spark, sf_dir).select("frame_no", F.concat(F.encode(F.lit("P6\n8 8\n255\n"), "US-ASCII"), F.unhex(body)).alias("content"))
    return c.select("frame_no", F.md5("content").alias("md5"), F.octet_length("content").cast("bigint").alias("size"))
