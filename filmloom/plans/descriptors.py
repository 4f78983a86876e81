"""Queries on codec descriptors, info texts, manifests, traces and small picture formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions import bits, colour
from filmloom.operators.quality import bracketed_level
from filmloom.plans.films import _hexed, turns
from filmloom.plans.queries import FRAMES_SQL, RGB_SQL, pictures, rgb
from filmloom.plans.registry import ORACLES, query, table
from filmloom.sources import descriptors
from filmloom.sources.films import unpacked
from filmloom.sources.files import write_files
from filmloom.sources.scratch import scratch

_LINES = ["YUV 8,8,8", "  6Y5UV 6,5,5", "RGB 5,5,5;YUV 5,5,5", "8", "YUV 6,6,6", "6Y6UV 6,6,6", "none", "RGB 6,5,5", "YUV 7"]
_INFO_TEXT = """p_name || chr(10) || p_brand || chr(10) || p_type || chr(10) || '160;' || p_size || chr(10) || '128 ; ' || p_size % 4 * 8 || ' step' || chr(10) || {six} || chr(10) || {seven} || chr(13) || chr(10) || 'end'"""


def _pick(seed: str) -> str:
    return "CASE " + f"({seed}) % {len(_LINES)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LINES)) + " END"


_TEXT = _INFO_TEXT.format(six=_pick("p_partkey * 5 + 1"), seven=_pick("p_partkey * 7 + 3"))
_COLOUR_SQL = """CASE WHEN starts_with(ltrim({x}), '6Y5UV') THEN '6Y5UV' WHEN starts_with(ltrim({x}), '6Y6UV') THEN '6Y6UV'
 WHEN regexp_matches({x}, '^ *(YUV|RGB)') THEN CASE WHEN regexp_matches({x}, '^ *... *8($|[^0-9])') THEN substr(ltrim({x}), 1, 3) || '888' WHEN regexp_matches({x}, '^ *... *5($|[^0-9])') THEN substr(ltrim({x}), 1, 3) || '555' WHEN regexp_matches({x}, '^ *... *6,6') THEN '6Y6UV' WHEN regexp_matches({x}, '^ *... *6') THEN '6Y5UV' END
 WHEN regexp_matches({x}, '^ *[0-9]') THEN 'PAL8' END"""


@query(
    "codec_infos",
    f"""WITH t AS (SELECT p_partkey, string_split(replace({_TEXT}, chr(13), ''), chr(10)) AS ls FROM part),
n AS (SELECT *, list_filter(ls, lambda x: {_COLOUR_SQL.format(x="x")} IS NOT NULL)[1] AS first, ls[7] AS seven FROM t),
c AS (SELECT *, CASE WHEN {_COLOUR_SQL.format(x="seven")} IS NOT NULL THEN seven ELSE first END AS line FROM n),
b AS (SELECT *, TRY_CAST(trim(string_split(ls[4], ';')[2]) AS BIGINT) AS x4, TRY_CAST(string_split(trim(string_split(ls[5], ';')[2]), ' ')[1] AS BIGINT) AS x5 FROM c)
SELECT p_partkey AS part, ls[1] AS info_name, {_COLOUR_SQL.format(x="line")} AS info_colour, contains(line, ';') AS several, CASE WHEN x4 IN (1, 2, 4, 8, 16, 32, 64) THEN x4 ELSE 1 END AS block_x, CASE WHEN x5 IN (1, 2, 4, 8, 16, 32, 64) THEN x5 ELSE 1 END AS block_y FROM b""",
)
def codec_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info texts of decoders, one a part: name, colours, whether there are alternatives, block sides."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.expr(_TEXT).alias("text"))
    return descriptors.infos(t, "text").drop("text")


_ASKED = [c[0] for c in descriptors.CODECS] + [33, 777, 701, 702]
_LABELS = ["", "16 bit rgb", "YUV 8,8,8", "bits per pixel [6y5uv]", "6Y6UV"]
_MOVIES_SQL = f"m AS (SELECT event_id, ({_ASKED})[event_id % {len(_ASKED)} + 1] AS codec, ({_LABELS})[event_id % {len(_LABELS)} + 1] AS label FROM events)"


@query(
    "described_movies",
    f"""WITH {_MOVIES_SQL}, k AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if v is None else "'" + v + "'" if isinstance(v, str) else str(v) for v in row) + ")" for row in descriptors.CODECS)}) AS t(codec, name, colour, by_label, way, wrapper)
 UNION ALL SELECT * FROM (VALUES (701, 'Own', 'RGB888', true, 'info', NULL), (702, 'Other', 'YUV555', false, 'info', NULL)) AS u(codec, name, colour, by_label, way, wrapper)),
j AS (SELECT m.*, name, colour, by_label, way, wrapper, upper(label) AS u, CASE WHEN colour = 'RGB888' THEN '888' ELSE '555' END AS deep FROM m LEFT JOIN k USING (codec))
SELECT event_id, CAST(codec AS BIGINT) AS codec, name, CASE WHEN NOT coalesce(by_label, false) THEN colour WHEN contains(u, '6Y5UV') THEN '6Y5UV' WHEN contains(u, '6Y6UV') THEN '6Y6UV' WHEN contains(u, 'YUV') THEN 'YUV' || deep WHEN contains(u, 'RGB') THEN 'RGB' || deep ELSE colour END AS colour,
 CASE WHEN way = 'info' THEN 'module' ELSE way END AS way, wrapper, CASE WHEN way IS NULL THEN 'unsupported' WHEN way = 'info' THEN 'info' ELSE 'ok' END AS status FROM j""",
)
def described_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies with what is known of their codecs, from the table or an info text, and their colours by their own labels."""
    pick = lambda values: F.array(*map(F.lit, values))[(F.col("event_id") % len(values)).cast("int")]
    m = table(spark, sf_dir, "events").select("event_id", pick(_ASKED).cast("bigint").alias("codec"), pick(_LABELS).alias("label"))
    texts = spark.createDataFrame([(701, "Own\n\n\n1;1\n1;1\n\nRGB 8,8,8;YUV 8,8,8\n"), (702, "Other\n\nYUV 5,5,5\n")], "codec bigint, text string")
    return descriptors.described(m, descriptors.codecs(spark), descriptors.infos(texts, "text"), "codec", "label").drop("label")


@query(
    "quoted_fields",
    """SELECT conv_id, turn, role || ' one' AS name, 'a=b' AS mark, CAST(turn AS VARCHAR) AS n, CAST(3 AS BIGINT) AS fields FROM conversations""",
)
def quoted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of report lines with quoted values that hold blanks and equal signs, the last of a name that comes twice."""
    t = turns(spark, sf_dir)
    line = F.concat(F.lit('frame n=0 name="'), F.col("role"), F.lit(" one\" alone mark='a=b' n="), F.col("turn").cast("string"))
    f = t.select("conv_id", "turn", F.explode(F.array(descriptors.quoted_fields(line))).alias("f"))
    return f.select("conv_id", "turn", F.col("f.name").alias("name"), F.col("f.mark").alias("mark"), F.col("f.n").alias("n"), F.size("f").cast("bigint").alias("fields"))


@query(
    "manifest_rows",
    """SELECT 'frame-' || vec_id AS name, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'frame-' || (vec_id - 1) || '.yuv' END AS previous, vec_id % 5 = 0 AS key_frame, 'set ' || vec_id % 3 AS provenance FROM embeddings""",
)
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of frame fixtures, written as files with remarks and read back."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    name = lambda k: F.concat(F.lit("frame-"), k.cast("string"))
    previous = F.when(F.col("vec_id") % 5 == 0, "-").otherwise(F.concat(name(F.col("vec_id") - 1), F.lit(".yuv")))
    line = F.concat_ws("\t", name(F.col("vec_id")), F.lit("8"), F.lit("8"), F.concat(name(F.col("vec_id")), F.lit(".bin")), previous, F.concat(name(F.col("vec_id")), F.lit(".yuv")), F.concat(F.lit("set "), (F.col("vec_id") % 3).cast("string")))
    head = F.when(F.col("vec_id") % 10 == 0, "# name width\n\n").otherwise("")
    path = scratch(spark, "manifests")
    write_files(e, path, F.concat(F.lit("manifest-"), (F.col("vec_id") % 4).cast("string"), F.lit(".tsv")), [F.col("vec_id")], F.encode(F.concat(head, line, F.lit("\n")), "UTF-8"))
    return descriptors.manifest(spark, path).select("name", "width", "height", "previous", "key_frame", "provenance")


@query(
    "encode_trace",
    ORACLES["bracketed_levels"].replace("SELECT event_id, CAST(probes[-1]", "SELECT * FROM (WITH x AS (SELECT event_id, CAST(probes[-1]").replace("FROM l WHERE rn = 1", "FROM l WHERE rn = 1), y AS (SELECT event_id, string_split(probes, ',') AS p, unnest(range(len(string_split(probes, ',')))) AS k FROM x), z AS (SELECT event_id, k, CAST(p[k + 1] AS BIGINT) AS level, k = len(p) - 1 AS kept, CAST(500 + floor(value * 8) AS BIGINT) * 32 // (32 + CAST(p[k + 1] AS BIGINT)) AS bytes FROM y JOIN events USING (event_id)) SELECT event_id, CAST(k AS BIGINT) AS retry, level, bytes, CASE WHEN bytes < 900 THEN 'below' WHEN bytes > 1025 THEN 'above' ELSE 'inside' END AS target, kept FROM z)"),
)
def encode_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every attempt of the bracketed search: its level, bytes, where these lie to the target, and whether it is the one kept."""
    size = lambda level: F.floor((500 + F.floor(F.col("value") * 8)) * 32 / (32 + level)).cast("bigint")
    e = table(spark, sf_dir, "events").select("event_id", "value", F.explode(F.array(bracketed_level(size, F.col("event_id") % 29, 1000))).alias("s"))
    t = e.select("event_id", "value", F.size("s.probes").alias("n"), F.posexplode("s.probes").alias("retry", "level")).withColumn("bytes", size(F.col("level")))
    target = F.when(F.col("bytes") < 900, "below").when(F.col("bytes") > 1025, "above").otherwise("inside")
    return t.select("event_id", F.col("retry").cast("bigint").alias("retry"), F.col("level").cast("bigint").alias("level"), "bytes", target.alias("target"), (F.col("retry") == F.col("n") - 1).alias("kept"))


_SCREENS_SQL = "CASE vec_id % 5 WHEN 0 THEN 27 WHEN 1 THEN 12 WHEN 2 THEN 15 WHEN 3 THEN 21 ELSE 28 END"


@query(
    "film_pixels",
    f"""WITH f AS (SELECT vec_id, {_SCREENS_SQL} AS mode, p, CAST(greatest(0, least(63, floor((v::DOUBLE + 1.0) * 32.0))) AS BIGINT) AS b FROM (SELECT vec_id, unnest(range(len(embedding))) AS p, unnest(embedding) AS v FROM embeddings)),
g AS (SELECT vec_id, mode, x, y, CASE WHEN mode = 27 THEN y * 4 + x // 2 WHEN mode = 12 THEN y // 2 * 4 + x // 2 WHEN mode = 15 THEN y // 2 * 8 + x ELSE y * 8 + x END AS p FROM (SELECT DISTINCT vec_id, mode FROM f), (SELECT unnest(range(8)) AS x), (SELECT unnest(range(8)) AS y)),
c AS (SELECT g.vec_id, g.mode, x, y, CASE WHEN g.mode IN (27, 12) THEN CASE WHEN x % 2 = 0 THEN b % 16 ELSE b // 16 END ELSE b END AS c FROM g JOIN f USING (vec_id, p))
SELECT vec_id, CAST(mode AS BIGINT) AS mode, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS total, CAST(sum(c * (y * 8 + x + 1)) AS BIGINT) AS placed FROM c GROUP BY vec_id, mode""",
)
def film_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored frames of films as pixels of a whole screen: two to a byte in some modes, rows doubled in others."""
    e = table(spark, sf_dir, "embeddings").withColumn("mode", F.expr(_SCREENS_SQL))
    stored = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(63), F.floor((v.cast("double") + 1.0) * 32.0))).cast("bigint"))
    px = unpacked(stored, F.lit(8), F.lit(8), F.col("mode"))
    e = e.select("vec_id", F.col("mode").cast("bigint").alias("mode"), px.alias("px"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)
    return e.select("vec_id", "mode", F.size("px").cast("bigint").alias("n"), add(F.col("px")).alias("total"), add(F.transform("px", lambda v, k: v * (k + 1))).alias("placed"))


#: A poster's sides in pixels; an odd width, so that rows are padded.
WIDE, HIGH = 7, 9


def poster(pixels: Column, width: int, height: int) -> Column:
    """A sprite area with one sprite of sixteen-bit pixels, rows padded to whole words."""
    padded = (2 * width + 3) // 4 * 4
    le = lambda n, size=4: bits.little_endian(F.lit(n), size)
    payload = 44 + padded * height
    words = [1, 16, 12 + payload + 4, payload]
    sprite = [padded // 4 - 1, height - 1, 0, ((2 * width + 3) % 4 + 1) * 8 - 1, 44, 44, 5 << 27 | 90 << 14 | 90 << 1 | 1]
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.concat(F.slice(pixels, r * width + 1, F.lit(width)), F.array_repeat(F.lit(0).cast("bigint"), padded // 2 - width)))
    body = _hexed(F.flatten(F.transform(F.flatten(rows), lambda v: F.array(v % 256, F.floor(v / 256).cast("bigint")))))
    return F.concat(*[le(w) for w in words], F.encode(F.lit("poster"), "US-ASCII"), F.unhex(F.lit("00" * 6)), *[le(w) for w in sprite], body)


_PADDED = (2 * WIDE + 3) // 4 * 4
_POSTER_HEAD = b"".join(n.to_bytes(4, "little") for n in (1, 16, 12 + 44 + _PADDED * HIGH + 4, 44 + _PADDED * HIGH)) + b"poster" + bytes(6) + b"".join(n.to_bytes(4, "little") for n in (_PADDED // 4 - 1, HIGH - 1, 0, ((2 * WIDE + 3) % 4 + 1) * 8 - 1, 44, 44, 5 << 27 | 90 << 14 | 90 << 1 | 1))


@query(
    "posters",
    f"""WITH {FRAMES_SQL}, w AS (SELECT frame_no, y * 8 + x AS k, (luma * 517) % 32768 AS w FROM frames WHERE y * 8 + x < {WIDE * HIGH}),
h AS (SELECT frame_no, string_agg(printf('%02X%02X', CAST(w % 256 AS INTEGER), CAST(w // 256 AS INTEGER)) || CASE WHEN k % {WIDE} = {WIDE - 1} THEN '{"0000" * (_PADDED // 2 - WIDE)}' ELSE '' END, '' ORDER BY k) AS body FROM w GROUP BY frame_no)
SELECT frame_no, md5('{_POSTER_HEAD.hex().upper()}' || body) AS digest, CAST({len(_POSTER_HEAD)} + len(body) // 2 AS BIGINT) AS size FROM h""",
)
def posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poster sprites of pictures: size, and the digest of their hex."""
    p = pictures(spark, sf_dir).select("frame_no", poster(F.transform(F.slice("luma", 1, WIDE * HIGH), lambda v: v * 517 % 32768), WIDE, HIGH).alias("s"))
    return p.select("frame_no", F.md5(F.encode(F.hex("s"), "US-ASCII")).alias("digest"), F.octet_length("s").cast("bigint").alias("size"))


@query(
    "true_sizes",
    """SELECT conv_id, CASE WHEN conv_id % 4 = 3 OR conv_id % 9 = 0 THEN 160 ELSE 100 + conv_id % 50 END::BIGINT AS width, CASE WHEN conv_id % 4 = 3 OR conv_id % 9 = 0 THEN 128 ELSE 1 + conv_id % 4096 END::BIGINT AS height FROM (SELECT DISTINCT conv_id FROM conversations)""",
)
def true_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of pictures from the first wrapper of a movie where they make sense, behind a palette in some, else from the header."""
    from filmloom.sources.films import true_size

    t = turns(spark, sf_dir).groupBy("conv_id").agg(F.min_by("body", "turn").alias("body"))
    wide = F.when(F.col("conv_id") % 9 == 0, 5000).otherwise(100 + F.col("conv_id") % 50)
    first = F.concat(bits.little_endian(F.octet_length("body") + 12, 4), F.unhex(F.lit("00" * 4)), bits.little_endian(wide, 4), bits.little_endian(1 + F.col("conv_id") % 4096, 4), F.col("body"))
    palette = F.concat(F.unhex(F.lit("FF" * 4)), F.unhex(F.repeat(F.lit("01020000"), 256)))
    chunk = F.when(F.col("conv_id") % 4 == 3, F.substring(first, 1, 15)).when(F.col("conv_id") % 2 == 0, F.concat(palette, first)).otherwise(first)
    size = true_size(chunk, F.col("conv_id") % 2 == 0, F.lit(160), F.lit(128))
    return t.select("conv_id", F.explode(F.array(size)).alias("s")).select("conv_id", "s.width", "s.height")


_FIVE = {"6Y5UV": (6, 5), "YUV555": (5, 5), "6Y6UV": (6, 6), "YUV888": (8, 8), "RGB888": (8, 8)}


@query(
    "pixel_fields",
    f"""WITH {RGB_SQL}, w AS (SELECT event_id, r + 256 * g + 65536 * b AS w FROM rgb), l AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {1 << a}, {1 << b})" for n, (a, b) in _FIVE.items())}) AS t(layout, a, b))
SELECT event_id, layout, w % a AS first, w // a % b AS second, w // (a * b) % b AS third, w % (a * b * b) AS again FROM w, l""",
)
def pixel_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken apart in all five layouts and put together again."""
    c = rgb(spark, sf_dir).select("event_id", (F.col("r") + 256 * F.col("g") + 65536 * F.col("b")).alias("w"))
    parts = []
    for layout in _FIVE:
        y, u, v = colour.fields(layout, F.col("w"))
        parts.append(F.struct(F.lit(layout).alias("layout"), y.alias("first"), u.alias("second"), v.alias("third"), colour.word(layout, y, u, v).alias("again")))
    return c.select("event_id", F.explode(F.array(*parts)).alias("p")).select("event_id", "p.*")


@query("bottom_up_rows", f"WITH {FRAMES_SQL} SELECT frame_no, CAST(sum(luma * ((7 - y) * 8 + x + 1)) AS BIGINT) AS placed FROM frames GROUP BY frame_no")
def bottom_up_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that are stored from the bottom row up, turned over."""
    p = pictures(spark, sf_dir).select("frame_no", colour.turned_over(F.col("luma"), 8).alias("l"))
    return p.select("frame_no", F.aggregate(F.transform("l", lambda v, k: v * (k + 1)), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("placed"))
