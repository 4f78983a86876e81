"""Queries on whole pictures in luma and chroma, pixel words, sample bytes and motion codes; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions import colour
from filmloom.operators.motion import vector_bits, vector_code_7
from filmloom.operators.pictures import best_vectors, best_vectors_by_level, copy_profiles, error_sums, region, signed, temporal_vectors, with_previous
from filmloom.operators.quality import THRESHOLDS
from filmloom.plans.queries import FRAMES_SQL, RGB_SQL, pictures, rgb
from filmloom.plans.registry import query, table

YUV = ["y", "u", "v"]


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures (frame_no, y, u, v): six-bit luma from the vectors, five-bit chroma from luma and place, as raw fields."""
    p = pictures(spark, sf_dir).withColumnRenamed("luma", "y")
    return p.select("frame_no", "y", F.transform("y", lambda l, i: (l * 5 + i) % 32).alias("u"), F.transform("y", lambda l, i: (l * 11 + 3 * i) % 32).alias("v"))


def coloured_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures with the one before, chroma signed."""
    c = coloured(spark, sf_dir)
    c = c.select("frame_no", "y", *[F.transform(p, lambda c: signed(c)).alias(p) for p in ("u", "v")])
    return with_previous(c, YUV)


_SIGNED = "CASE WHEN {0} < 16 THEN {0} ELSE {0} - 32 END"
YUV_SQL = f"""{FRAMES_SQL}, raw AS (SELECT frame_no, x, y AS row_no, luma AS y, (luma * 5 + y * 8 + x) % 32 AS u, (luma * 11 + 3 * (y * 8 + x)) % 32 AS v FROM frames),
yuv AS (SELECT frame_no, x, row_no, y, {_SIGNED.format("u")} AS u, {_SIGNED.format("v")} AS v FROM raw)"""
_D_SQL = "d AS (SELECT c.frame_no, c.x, c.row_no, c.y - p.y AS dy, c.u - p.u AS du, c.v - p.v AS dv FROM yuv c JOIN yuv p ON p.frame_no + 1 = c.frame_no AND p.x = c.x AND p.row_no = c.row_no)"
_SUMS = ", ".join(f"CAST(sum(d{p} * d{p}){w} AS BIGINT) AS {n}sse_{p}, CAST(max(abs(d{p})){w} AS BIGINT) AS {n}most_{p}" for n, w in (("", ""), ("region_", " FILTER (x BETWEEN 2 AND 6 AND row_no BETWEEN 1 AND 4)")) for p in YUV)


@query("frame_metrics_yuv", f"WITH {YUV_SQL}, {_D_SQL} SELECT frame_no, CAST(count(*) AS BIGINT) AS n, {_SUMS} FROM d GROUP BY frame_no")
def frame_metrics_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared and largest errors of every plane against the picture before, of the whole picture and of a rectangle in it."""
    p = coloured_pairs(spark, sf_dir)
    out = []
    for name, where in (("", None), ("region_", region(2, 1, 5, 4, 8))):
        for plane in YUV:
            sse, most = error_sums(F.col(plane), F.col(f"prev_{plane}"), where)
            out += [sse.alias(f"{name}sse_{plane}"), most.alias(f"{name}most_{plane}")]
    return p.select("frame_no", F.size("y").cast("bigint").alias("n"), *out)


_OVER = ", ".join(f"CAST(count(*) FILTER (abs(c.y - p.y) > {k}) AS BIGINT) AS over_{k}" for k in range(7))


def _copies_sql(block: int, pair: str) -> str:
    """Profiles of copies; ``pair`` joins current pixels c with those p that they are copied from."""
    area = block * block
    u, v = (f"abs(CAST(floor(sum(c.{q}) / {area}) AS BIGINT) - CAST(floor(sum(p.{q}) / {area}) AS BIGINT))" for q in ("u", "v"))
    return f"CAST(sum(abs(c.y - p.y)) + {area} * ({u} + {v}) AS BIGINT) AS total, CAST(max(abs(c.y - p.y)) AS BIGINT) AS most, {_OVER}, CAST({u} AS BIGINT) AS u_error, CAST({v} AS BIGINT) AS v_error {pair}"


def _level_sql(block: int) -> str:
    rare, column = (4, 2) if block == 4 else (1, 3)
    return "CASE " + " ".join(f"WHEN most <= {t[1]} AND over_{t[0]} <= {rare} AND u_error <= {t[0]} AND v_error <= {t[0]} AND total <= {t[column]} THEN {i}" for i, t in enumerate(THRESHOLDS)) + f" ELSE {len(THRESHOLDS)} END"


def _profile_sql(block: int) -> str:
    same = f"FROM yuv c JOIN yuv p ON p.frame_no + 1 = c.frame_no AND p.x = c.x AND p.row_no = c.row_no GROUP BY c.frame_no, c.x // {block}, c.row_no // {block}"
    return f"profile AS (SELECT c.frame_no AS frame_no, CAST(c.x // {block} AS BIGINT) AS bx, CAST(c.row_no // {block} AS BIGINT) AS brow, {_copies_sql(block, same)})"


@query("copy_profile_4x4", f"WITH {YUV_SQL}, {_profile_sql(4)} SELECT *, CAST({_level_sql(4)} AS BIGINT) AS level FROM profile")
def copy_profile_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stationary 4x4 copies with their chroma errors and the strictest loss level that takes each."""
    return copy_profiles(coloured_pairs(spark, sf_dir), 4, YUV)


@query("copy_profile_2x2", f"WITH {YUV_SQL}, {_profile_sql(2)} SELECT *, CAST({_level_sql(2)} AS BIGINT) AS level FROM profile")
def copy_profile_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stationary 2x2 copies with their chroma errors and the strictest loss level that takes each."""
    return copy_profiles(coloured_pairs(spark, sf_dir), 2, YUV)


#: Loss levels of the search by level and of the policies.
LEVELS, POLICY_LEVEL = [8, 16, 22, 28], 28
_V_SQL = "v AS (SELECT row_number() OVER (ORDER BY least(4, greatest(abs(dx), abs(dy))), dy, dx) - 1 AS ord, dx, dy FROM (SELECT unnest(range(-8, 9)) AS dx) a, (SELECT unnest(range(-8, 9)) AS dy) b WHERE dx <> 0 OR dy <> 0)"
_MOVED_SQL = f"""{_V_SQL}, moved AS (SELECT c.frame_no AS frame_no, CAST(c.x // 4 AS BIGINT) AS bx, CAST(c.row_no // 4 AS BIGINT) AS brow, ord, dx, dy,
 {_copies_sql(4, '''FROM yuv c JOIN v ON (c.x // 4) * 4 + dx BETWEEN 0 AND 4 AND (c.row_no // 4) * 4 + dy BETWEEN 0 AND 4
 JOIN yuv p ON p.frame_no + 1 = c.frame_no AND p.x = c.x + dx AND p.row_no = c.row_no + dy GROUP BY c.frame_no, c.x // 4, c.row_no // 4, ord, dx, dy''')}),
first AS (SELECT *, {_level_sql(4)} AS first_level FROM moved)"""
_BY_LEVEL_SQL = f"""{_MOVED_SQL}, by_level AS (SELECT frame_no, bx, brow, level, err, dx, dy FROM (SELECT frame_no, bx, brow, l AS level, total AS err, dx, dy,
 row_number() OVER (PARTITION BY frame_no, bx, brow, l ORDER BY total, ord) AS rn FROM first JOIN (SELECT unnest({LEVELS}) AS l) ON first_level <= l) WHERE rn = 1)"""


@query("best_vector_by_level", f"WITH {YUV_SQL}, {_BY_LEVEL_SQL} SELECT frame_no, bx, brow, CAST(level AS BIGINT) AS level, err, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy FROM by_level")
def best_vector_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per 4x4 block and loss level the best of all in-frame vectors that the level accepts, chroma included."""
    return best_vectors_by_level(coloured_pairs(spark, sf_dir), YUV, LEVELS)


_BITS = "CASE WHEN greatest(abs(dx), abs(dy)) <= 1 THEN 7 WHEN greatest(abs(dx), abs(dy)) = 2 THEN 8 WHEN greatest(abs(dx), abs(dy)) = 3 THEN 9 ELSE 12 END"
_POLICY_SQL = f"""WITH {YUV_SQL}, {_profile_sql(4)}, {_BY_LEVEL_SQL}, t AS (SELECT * FROM by_level WHERE level = {POLICY_LEVEL}),
c AS (SELECT p.frame_no, p.bx, p.brow, CASE WHEN {_level_sql(4)} <= {POLICY_LEVEL} THEN total END AS still, t.err AS moved, {_BITS} AS bits FROM profile p LEFT JOIN t USING (frame_no, bx, brow))
SELECT frame_no, bx, brow, CASE WHEN still IS NOT NULL THEN 'stationary' WHEN moved IS NOT NULL THEN 'temporal' ELSE 'data' END AS ordered,
 CASE WHEN still IS NULL AND moved IS NULL THEN 'data' WHEN moved IS NULL OR still <= moved THEN 'stationary' ELSE 'temporal' END AS lowest,
 CAST(CASE WHEN still IS NOT NULL THEN 2 WHEN moved IS NOT NULL THEN bits END AS BIGINT) AS ordered_bits,
 CAST(CASE WHEN still IS NULL AND moved IS NULL THEN NULL WHEN moved IS NULL OR still <= moved THEN 2 ELSE bits END AS BIGINT) AS lowest_bits FROM c"""


@query("copy_policies", _POLICY_SQL)
def copy_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per 4x4 block the copy that each policy takes at one loss level: the first family that the level accepts, or the least error, fewer bits of equals."""
    pairs = coloured_pairs(spark, sf_dir)
    keys = ["frame_no", "bx", "brow"]
    still = copy_profiles(pairs, 4, YUV).select(*keys, F.when(F.col("level") <= POLICY_LEVEL, F.col("total")).alias("still"))
    moved = best_vectors_by_level(pairs, YUV, [POLICY_LEVEL]).select(*keys, F.col("err").alias("moved"), vector_bits(F.col("dx"), F.col("dy")).alias("bits"))
    c = still.join(moved, keys, "left")
    stays, moves = F.col("still").isNotNull(), F.col("moved").isNotNull()
    least = stays & (~moves | (F.col("still") <= F.col("moved")))
    name = lambda first: F.when(first, "stationary").when(moves, "temporal").otherwise("data")
    cost = lambda first: F.when(first, F.lit(2)).when(moves, F.col("bits")).cast("bigint")
    return c.select(*keys, name(stays).alias("ordered"), name(least).alias("lowest"), cost(stays).alias("ordered_bits"), cost(least).alias("lowest_bits"))


@query(
    "block_chroma_means",
    f"WITH {YUV_SQL} SELECT frame_no, CAST(x // 4 AS BIGINT) AS bx, CAST(row_no // 4 AS BIGINT) AS brow, CAST(floor(sum(u) / 16) AS BIGINT) & 31 AS u, CAST(floor(sum(v) / 16) AS BIGINT) & 31 AS v FROM yuv GROUP BY ALL",
)
def block_chroma_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chroma that a 4x4 block is sent with: means of signed chroma, rounded down, as raw fields."""
    c = coloured(spark, sf_dir)
    blocks = F.explode(F.array(*[F.struct(F.lit(x).cast("bigint").alias("bx"), F.lit(y).cast("bigint").alias("brow"), region(4 * x, 4 * y, 4, 4, 8).alias("at")) for y in range(2) for x in range(2)]))
    mean = lambda p: F.floor(F.aggregate(F.col("b.at"), F.lit(0).cast("bigint"), lambda s, i: s + signed(F.get(F.col(p), i))) / 16).bitwiseAND(F.lit(31))
    return c.select("*", blocks.alias("b")).select("frame_no", "b.bx", "b.brow", mean("u").alias("u"), mean("v").alias("v"))


@query(
    "carried_chroma",
    f"""WITH {YUV_SQL}, m AS (SELECT frame_no, row_no // 4 * 2 + x // 4 AS k, CAST(floor(sum(u) / 16) AS BIGINT) AS u, CAST(floor(sum(v) / 16) AS BIGINT) AS v, max(y) AS most FROM yuv GROUP BY ALL),
d AS (SELECT *, lag(u, 1, 0) OVER (PARTITION BY frame_no ORDER BY k) AS pu, lag(v, 1, 0) OVER (PARTITION BY frame_no ORDER BY k) AS pv FROM m WHERE most % 4 <> 0)
SELECT frame_no, CAST(k AS BIGINT) AS k, (u - pu) & 31 AS du, (v - pv) & 31 AS dv FROM d""",
)
def carried_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma of data-coded blocks as differences from the last data-coded block of the picture, modulo 32; the first from zero.

    Data-coded are here blocks whose largest luma is no multiple of four. The fold is over a picture's own blocks.
    """
    from pyspark.sql import Window

    c = coloured(spark, sf_dir)
    blocks = F.posexplode(F.array(*[region(4 * x, 4 * y, 4, 4, 8) for y in range(2) for x in range(2)]))
    mean = lambda p: F.floor(F.aggregate(F.col("at"), F.lit(0).cast("bigint"), lambda s, i: s + signed(F.get(F.col(p), i))) / 16)
    b = c.select("*", blocks.alias("k", "at")).where(F.array_max(F.transform("at", lambda i: F.get("y", i))) % 4 != 0)
    b = b.select("frame_no", F.col("k").cast("bigint").alias("k"), mean("u").alias("u"), mean("v").alias("v"))
    last = Window.partitionBy("frame_no").orderBy("k")
    diff = lambda p: (F.col(p) - F.coalesce(F.lag(p).over(last), F.lit(0))).bitwiseAND(F.lit(31))
    return b.select("frame_no", "k", diff("u").alias("du"), diff("v").alias("dv"))


@query(
    "pixel_words",
    f"""WITH {RGB_SQL}, f AS (SELECT event_id, r & 63 AS y, g & 31 AS u, b & 31 AS v, r & 127 AS wide FROM rgb)
SELECT event_id, CASE WHEN wide <= 63 THEN wide | (u << 6) | (v << 11) END AS w6y5uv, (y & 31) | (u << 5) | (v << 10) AS w555, y | (u << 6) | (v << 12) AS w6y6uv,
  ((y & 31) * 63 + 15) // 31 AS y6, wide > 63 AS bad FROM f""",
)
def pixel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels packed into words of three layouts, null where a field is out of range, and five-bit luma widened to six bits."""
    c = rgb(spark, sf_dir)
    low = lambda n, m: F.col(n).bitwiseAND(F.lit(m))
    c = c.select("event_id", low("r", 63).alias("y"), low("g", 31).alias("u"), low("b", 31).alias("v"), low("r", 127).alias("wide"))
    return c.select(
        "event_id", colour.word("6Y5UV", F.col("wide"), F.col("u"), F.col("v")).alias("w6y5uv"), colour.word("YUV555", low("y", 31), F.col("u"), F.col("v")).alias("w555"),
        colour.word("6Y6UV", F.col("y"), F.col("u"), F.col("v")).alias("w6y6uv"), F.floor((low("y", 31) * 63 + 15) / 31).alias("y6"), (F.col("wide") > 63).alias("bad"),
    )


_BYTES_SQL = "payload AS (SELECT conv_id, turn, i, instr('123456789ABCDEF', h[2 * i + 1]) * 16 + instr('123456789ABCDEF', h[2 * i + 2]) AS b, len(h) // 2 AS n FROM (SELECT conv_id, turn, h, unnest(range(len(h) // 2)) AS i FROM (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations)))"


def payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, p): a chunk's payload."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("p")).where(F.length("p") > 0)


def byte(p: str, at) -> F.Column:
    """The byte at a place of a binary column."""
    return F.conv(F.hex(F.substring(p, at + 1, 1)), 16, 10).cast("bigint")


@query(
    "type2_frames",
    f"""WITH {_BYTES_SQL}, w AS (SELECT conv_id, turn, i // 2 AS px, sum(CASE WHEN i % 2 = 0 THEN b ELSE b * 256 END) AS w FROM payload WHERE i // 2 < n // 32 * 16 GROUP BY ALL)
SELECT conv_id, turn, CAST(px // 16 AS BIGINT) AS frame_no, CAST(sum(CAST(w AS BIGINT) & 63) AS BIGINT) AS y, CAST(sum((CAST(w AS BIGINT) >> 6) & 31) AS BIGINT) AS u, CAST(sum((CAST(w AS BIGINT) >> 11) & 31) AS BIGINT) AS v FROM w GROUP BY ALL""",
)
def type2_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as frames of 4x4 pixels in 16-bit words, low byte first: sums of the three fields of every whole frame."""
    p = payload_bytes(spark, sf_dir).select("conv_id", "turn", "p", F.explode(F.sequence(F.lit(0), F.floor(F.length("p") / 32) - 1)).alias("frame_no")).where("frame_no >= 0 and length(p) >= 32")
    frame = p.select("conv_id", "turn", F.col("frame_no").cast("bigint"), F.hex(F.expr("substring(p, cast(frame_no * 32 + 1 as int), 32)")).alias("h"))
    words = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.conv(F.concat(F.col("h").substr(k * 4 + 3, F.lit(2)), F.col("h").substr(k * 4 + 1, F.lit(2))), 16, 10).cast("bigint"))
    frame = frame.select("conv_id", "turn", "frame_no", words.alias("w"))
    total = lambda shift, mask: F.aggregate("w", F.lit(0).cast("bigint"), lambda s, w: s + F.shiftright(w, shift).bitwiseAND(F.lit(mask)))
    return frame.select("conv_id", "turn", "frame_no", total(0, 63).alias("y"), total(6, 31).alias("u"), total(11, 31).alias("v"))


@query(
    "pixel_pairs_unpack",
    f"""WITH {_BYTES_SQL}, r AS (SELECT conv_id, turn, i // 11 AS run, sum(CAST(b AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST(8 * (i % 11) AS INT))) AS h FROM payload GROUP BY ALL HAVING count(*) = 11),
q AS (SELECT conv_id, turn, run * 4 + k AS pair, CAST(h // (CAST(1 AS HUGEINT) << CAST(22 * k AS INT)) % 4194304 AS BIGINT) AS w FROM r, (SELECT unnest(range(4)) AS k))
SELECT conv_id, turn, CAST(pair AS BIGINT) AS pair, w & 63 AS y0, (w >> 6) & 63 AS y1, (w >> 12) & 31 AS u, (w >> 17) & 31 AS v FROM q""",
)
def pixel_pairs_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as pairs of pixels in 22 bits, lowest bit first: two lumas and their chroma, of every whole run of eleven bytes."""
    p = payload_bytes(spark, sf_dir).where(F.length("p") >= 11).select("conv_id", "turn", "p", F.explode(F.sequence(F.lit(0), F.floor(F.length("p") / 11).cast("int") - 1)).alias("run"))
    own = p.select("conv_id", "turn", "run", F.transform(F.sequence(F.lit(10), F.lit(0)), lambda k: F.expr("p").substr(F.col("run") * 11 + k + 1, F.lit(1))).alias("bytes"))
    # eleven bytes are more than a long holds: bits as text, the last byte first
    own = own.select("conv_id", "turn", "run", F.array_join(F.transform("bytes", lambda b: F.lpad(F.conv(F.hex(b), 16, 2), 8, "0")), "").alias("bits"))
    own = own.select("conv_id", "turn", "run", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.col("bits").substr(67 - 22 * k, F.lit(22)), 2, 10).cast("bigint"))).alias("k", "w"))
    part = lambda at, mask: F.shiftright("w", at).bitwiseAND(F.lit(mask))
    return own.select("conv_id", "turn", (F.col("run") * 4 + F.col("k")).cast("bigint").alias("pair"), part(0, 63).alias("y0"), part(6, 63).alias("y1"), part(12, 31).alias("u"), part(17, 31).alias("v"))


@query(
    "pcm_bytes",
    f"""WITH {_BYTES_SQL}, s AS (SELECT conv_id, turn, n, i, b, lead(b) OVER (PARTITION BY conv_id, turn ORDER BY i) AS next FROM payload)
SELECT conv_id, turn, CAST(sum((b - 128) * 256) AS BIGINT) AS u8_total, CAST(coalesce(sum(CASE WHEN i % 2 = 0 AND next IS NOT NULL THEN next * 256 + b - CASE WHEN next >= 128 THEN 65536 ELSE 0 END END), 0) AS BIGINT) AS s16_total,
  CAST(coalesce(sum(CASE WHEN i % 2 = 0 AND next IS NOT NULL THEN (next - 128) * 256 - (b - 128) * 256 END), 0) AS BIGINT) AS right_less_left FROM s GROUP BY conv_id, turn""",
)
def pcm_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as samples: unsigned bytes, sixteen-bit words with the low byte first, and stereo bytes with the channels reversed."""
    p = payload_bytes(spark, sf_dir)
    # pairs of hex digits, one a byte
    b = p.select("conv_id", "turn", F.transform(F.regexp_extract_all(F.hex("p"), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("bigint")).alias("b"))
    b = b.withColumn("pairs", F.sequence(F.lit(0), F.floor(F.size("b") / 2).cast("int") - 1)).withColumn("pairs", F.when(F.size("b") >= 2, F.col("pairs")).otherwise(F.array().cast("array<int>")))
    total = lambda arr, f: F.aggregate(arr, F.lit(0).cast("bigint"), lambda s, x: s + f(x))
    low, high = lambda k: F.get("b", 2 * k), lambda k: F.get("b", 2 * k + 1)
    s16 = lambda k: high(k) * 256 + low(k) - F.when(high(k) >= 128, 65536).otherwise(0)
    return b.select("conv_id", "turn", total("b", lambda x: (x - 128) * 256).alias("u8_total"), total("pairs", s16).alias("s16_total"), total("pairs", lambda k: (high(k) - low(k)) * 256).alias("right_less_left"))


_7_SQL = f"""WITH {FRAMES_SQL}, v AS (SELECT row_number() OVER (ORDER BY CASE greatest(abs(dx), abs(dy)) WHEN 4 THEN 2.5 ELSE greatest(abs(dx), abs(dy)) END, dy, dx) - 1 AS ord, dx, dy FROM (SELECT unnest(range(-4, 5)) AS dx) a, (SELECT unnest(range(-4, 5)) AS dy) b WHERE dx <> 0 OR dy <> 0),
m AS (SELECT c.frame_no, c.x // 4 AS bx, c.y // 4 AS brow, ord, dx, dy, sum(abs(c.luma - p.luma)) AS err FROM frames c JOIN v ON (c.x // 4) * 4 + dx BETWEEN 0 AND 4 AND (c.y // 4) * 4 + dy BETWEEN 0 AND 4
  JOIN frames p ON p.frame_no + 1 = c.frame_no AND p.x = c.x + dx AND p.y = c.y + dy GROUP BY ALL),
b AS (SELECT *, greatest(abs(dx), abs(dy)) AS r FROM (SELECT *, row_number() OVER (PARTITION BY frame_no, bx, brow ORDER BY err, ord) AS rn FROM m) WHERE rn = 1)
SELECT frame_no, CAST(bx AS BIGINT) AS bx, CAST(brow AS BIGINT) AS brow, CAST(err AS BIGINT) AS err, CAST(CASE r WHEN 1 THEN 2 + 4 * ord WHEN 2 THEN 1 + 4 * (ord - 8) ELSE 3 + 4 * (ord - 24) END AS BIGINT) AS code, CAST(CASE r WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 8 END AS BIGINT) AS bits FROM b"""


@query("motion_codes_7", _7_SQL)
def motion_codes_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best vectors within four pixels in the code order of the older format, and their codes."""
    order = sorted(temporal_vectors(4), key=lambda v: ({4: 2.5}.get(max(map(abs, v)), max(map(abs, v))), v[1], v[0]))
    b = best_vectors(with_previous(pictures(spark, sf_dir), ["luma"]), ["luma"], vectors=order)
    code, bits = vector_code_7(F.col("ord"), F.col("dx"), F.col("dy"))
    return b.select("frame_no", "bx", "brow", "err", code.alias("code"), bits.alias("bits"))
