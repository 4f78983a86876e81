"""Queries over films, wrapped and raw frames, palettes and sound that goes on over chunks. All are made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions import audio, bits
from filmloom.operators.scan import adpcm_track, prefix_scan
from filmloom.plans.media import _ESCAPE_SQL, _IMA_SIZE, _MOVE_SQL
from filmloom.plans.registry import query, table
from filmloom.sources import films
from filmloom.sources.files import raw_frames as read_frames
from filmloom.sources.files import write_files
from filmloom.sources.scratch import scratch
from filmloom.sources.walks import walked, wrapped


def _le(n: Column, size: int = 4) -> Column:
    return bits.little_endian(n, size)


def _ascii(t: str) -> Column:
    return F.encode(F.lit(t), "US-ASCII")


def _hexed(values: Column) -> Column:
    """Binary of an array of bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, body): turns with their text as bytes."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))


def _joined(rows: DataFrame, body: Column, name: str) -> DataFrame:
    """Per conversation its turns' bytes one behind the other: a film is one row here, as it is where it is read."""
    return rows.select("conv_id", "turn", body.alias("_b")).groupBy("conv_id").agg(F.expr("listagg(_b, X'') WITHIN GROUP (ORDER BY turn)").alias(name))


# What a conversation's film looks like, in both dialects.
_C = {
    "raw_mode": "CASE conv_id % 9 WHEN 0 THEN 21 WHEN 1 THEN 28 WHEN 2 THEN 27 WHEN 3 THEN 12 WHEN 4 THEN 15 WHEN 5 THEN 13 WHEN 6 THEN 402653185 WHEN 7 THEN 671088641 ELSE 99 END",
    "technique": "CASE WHEN conv_id % 13 = 12 THEN 3 ELSE conv_id % 3 END",
    "width": "CASE WHEN conv_id % 11 = 10 THEN 0 ELSE 8 + conv_id % 5 END",
    "height": "6 + conv_id % 4",
    "entries": "conv_id % 20",
    "kind": "CASE WHEN conv_id % 5 = 4 THEN 3 ELSE 1 + conv_id % 2 END",
}


def film_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, content): a film of each conversation, its turns as frames and, all together, as sound."""
    t = turns(spark, sf_dir)
    size = 8 + F.octet_length("body")
    frames = _joined(t, F.concat(_le(size), F.col("body"), _le(size)), "frames")
    own = frames.join(_joined(t, F.col("body"), "sound"), "conv_id").join(t.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role")), "conv_id")
    c = {n: F.expr(x).cast("bigint") for n, x in _C.items()}
    info = F.encode("role", "UTF-8")
    body = F.concat(_le(44 + F.octet_length("frames")), *[_le(F.lit(0))] * 3, _le(F.lit(40)), _le(2 * c["width"]), _le(2 * c["height"]), _le(c["raw_mode"]), _le(c["technique"]), _le(F.col("conv_id") % 2), F.col("frames"), _le(F.lit(0)))
    entry = lambda k: F.array(k, (F.col("conv_id") * 3 + k * 5) % 256, (F.col("conv_id") + k * 11) % 256, k * 29 % 256)
    entries = F.when(c["entries"] > 0, _hexed(F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), c["entries"] - 1), entry)))).otherwise(_ascii(""))
    n = F.octet_length("sound")
    inner = F.concat(_ascii("WAV"), F.encode(c["kind"].cast("string"), "US-ASCII"), _le(28 + n + F.when(F.col("conv_id") % 9 == 8, 100).otherwise(0)), *[_le(F.lit(0))] * 5, F.col("sound"))
    sound = F.when(F.col("conv_id") % 7 == 6, _ascii("")).otherwise(F.concat(_ascii("SOUN"), _le(8 + F.octet_length(inner) + F.when(F.col("conv_id") % 10 == 9, 1).otherwise(0)), inner))
    content = F.concat(_ascii("INFO"), _le(8 + F.octet_length(info)), info, _ascii("ACEF"), _le(8 + F.octet_length(body)), body, _ascii("PALE"), _le(36 + 4 * c["entries"]), *[_le(F.lit(0))] * 7, entries, sound)
    return own.select("conv_id", content.alias("content"))


_FILM_SQL = f"""f AS (SELECT conv_id, {_C["technique"]} AS technique, {_C["width"]} AS w, {_C["height"]} AS h, {_C["entries"]} AS entries,
 CASE conv_id % 9 WHEN 6 THEN 27 WHEN 7 THEN 28 ELSE {_C["raw_mode"]} END AS mode, conv_id % 9 = 7 AS deep FROM (SELECT DISTINCT conv_id FROM conversations)),
film AS (SELECT *, CASE WHEN technique > 2 THEN 'unknown technique' WHEN w = 0 THEN 'no size' WHEN mode = 99 THEN 'unknown mode'
 WHEN NOT deep AND (mode IN (27, 12, 13, 39) AND w % 2 = 1 OR mode IN (12, 13, 39, 15, 36, 40) AND h % 2 = 1) THEN 'odd size' ELSE 'ok' END AS status,
 CASE WHEN deep THEN 2 * w * h WHEN mode IN (12, 13) THEN (w // 2) * (h // 2) WHEN mode = 27 THEN (w // 2) * h WHEN mode = 15 THEN w * (h // 2) ELSE w * h END AS frame_bytes FROM f)"""


@query(
    "film_headers",
    f"""WITH {_FILM_SQL}, p AS (SELECT conv_id, sum((conv_id * 3 + k * 5) % 256 + 2 * ((conv_id + k * 11) % 256) + 4 * (k * 29 % 256)) AS colours FROM (SELECT conv_id, unnest(range(conv_id % 20)) AS k FROM f) GROUP BY conv_id)
SELECT conv_id, status, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(mode AS BIGINT) AS mode, CAST(technique AS BIGINT) AS technique, CAST(frame_bytes AS BIGINT) AS frame_bytes, CAST(entries AS BIGINT) AS entries, CAST(coalesce(colours, 0) AS BIGINT) AS colours
FROM film LEFT JOIN p USING (conv_id)""",
)
def film_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per film its header's fields, the size of an unpacked frame, the palette, and whether it can be shown."""
    h = films.headers(film_files(spark, sf_dir), "conv_id")
    colours = F.aggregate("film.palette", F.lit(0).cast("bigint"), lambda a, e: a + e["r"] + 2 * e["g"] + 4 * e["b"])
    return h.select("conv_id", "status", "film.width", "film.height", "film.mode", "film.technique", "frame_bytes", F.size("film.palette").cast("bigint").alias("entries"), colours.alias("colours"))


@query(
    "film_frames",
    f"""WITH {_FILM_SQL}, t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_no,
 coalesce(sum(8 + strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 8 + strlen(first_value(role) OVER (PARTITION BY conv_id ORDER BY turn)) AS info FROM conversations)
SELECT conv_id, CAST(frame_no AS BIGINT) AS frame_no, CAST(info + 48 + before + 4 AS BIGINT) AS "offset", CAST(strlen(text) AS BIGINT) AS size, md5(text) AS digest FROM t JOIN film USING (conv_id) WHERE status = 'ok'""",
)
def film_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored frames of films that can be shown: where each lies, its size and its digest."""
    f = films.frames(film_files(spark, sf_dir), "conv_id")
    return f.select("conv_id", "frame_no", "offset", F.octet_length("body").cast("bigint").alias("size"), F.md5("body").alias("digest"))


def _sums(samples: Column) -> list[Column]:
    """How many samples, their sum, and their sum weighed by place."""
    placed = F.transform(samples, lambda v, k: v * (k + 1))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, v: s + v)
    return [F.size(samples).cast("bigint").alias("n"), total(samples).alias("total"), total(placed).alias("placed")]


def _serial_sql(codes: str, size: str) -> str:
    """One fold over all codes of a track, with samples and step indices before each code."""
    p = f"greatest(-32768, least(32767, a.p + CASE WHEN x >= 8 THEN -({size}) ELSE {size} END))::BIGINT"
    return f"list_reduce({codes}, lambda a, x: {{'p': {p}, 'i': ({_MOVE_SQL})::BIGINT, 'out': list_append(a.out, {p}), 'at': list_append(a.at, a.i)}}, {{'p': 0::BIGINT, 'i': 0::BIGINT, 'out': []::BIGINT[], 'at': []::BIGINT[]}})"


_SUMS_SQL = "CAST(len({x}) AS BIGINT) AS n, CAST(list_sum({x}) AS BIGINT) AS total, CAST(list_sum(list_transform(range(1, len({x}) + 1), lambda k: k * ({x})[k])) AS BIGINT) AS placed"
_HIGH_FIRST = "list_transform(range(1, strlen(h) + 1), lambda k: CAST(instr('123456789ABCDEF', h[k]) AS BIGINT))"


@query(
    "iota_sound",
    f"""WITH s AS (SELECT conv_id, hex(encode(string_agg(coalesce(text, ''), '' ORDER BY turn))) AS h, {_C["kind"]} AS kind FROM conversations GROUP BY conv_id),
d AS (SELECT conv_id, 'WAV' || kind AS kind, CASE WHEN kind = 1 THEN list_transform(range(1, strlen(h) // 2 + 1), lambda k: CAST(instr('123456789ABCDEF', h[2 * k - 1]) * 16 + instr('123456789ABCDEF', h[2 * k]) AS BIGINT)) ELSE {_HIGH_FIRST} END AS codes, CASE WHEN kind = 1 THEN 1024 ELSE 2048 END AS per FROM s WHERE conv_id % 7 <> 6 AND kind < 3 AND strlen(h) > 0),
o AS (SELECT conv_id, kind, per, CASE WHEN kind = 'WAV1' THEN list_transform(codes, lambda c: CAST(CASE WHEN c % 2 = 1 THEN -1 ELSE 1 END * (8 * (16 + (c // 2) % 16) * (1 << (c // 32)) - 128) AS BIGINT)) ELSE ({_serial_sql("codes", _IMA_SIZE)}).out END AS out FROM d),
b AS (SELECT conv_id, kind, block, list_slice(out, block * per + 1, (block + 1) * per) AS x FROM (SELECT *, unnest(range((len(out) + per - 1) // per)) AS block FROM o))
SELECT conv_id, kind, CAST(block AS BIGINT) AS block, {_SUMS_SQL.format(x="x")} FROM b""",
)
def iota_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The films' sound in blocks, coded sound decoded in parallel as one track."""
    s = films.sound(film_files(spark, sf_dir), "conv_id")
    return s.select("conv_id", "kind", "block", *_sums(F.col("samples")))


@query(
    "escape_adpcm_track",
    f"""WITH t AS (SELECT conv_id, turn, {_HIGH_FIRST} AS codes FROM (SELECT conv_id, turn, hex(encode(coalesce(text, ''))) AS h FROM conversations)),
c AS (SELECT conv_id, turn, ch, list_filter(codes, lambda x, k: conv_id % 2 = 0 OR (k - 1) % 2 = ch) AS codes FROM t, (SELECT unnest([0, 1]) AS ch) WHERE ch = 0 OR conv_id % 2 = 1),
n AS (SELECT conv_id, turn, ch, len(codes) AS n, coalesce(sum(len(codes)) OVER (PARTITION BY conv_id, ch ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c),
s AS (SELECT conv_id, ch, {_serial_sql("flatten(list(codes ORDER BY turn))", f"((x % 8) * ({_ESCAPE_SQL})[a.i + 1]) >> 2")} AS s FROM c GROUP BY conv_id, ch),
x AS (SELECT conv_id, turn, ch, CASE WHEN before = 0 THEN 0 ELSE s.out[before] END AS sample, s.at[before + 1] AS step, list_slice(s.out, before + 1, before + n.n) AS x FROM n JOIN s USING (conv_id, ch) WHERE n.n > 0)
SELECT conv_id, turn, CAST(ch AS BIGINT) AS channel, sample, step, {_SUMS_SQL.format(x="x")} FROM x""",
)
def escape_adpcm_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tracks whose state goes on from turn to turn, odd ones in stereo: the state before each turn and its samples."""
    t = turns(spark, sf_dir).withColumn("codes", audio.nibbles(F.col("body"), True))
    of = lambda ch: F.filter("codes", lambda _, k: k % 2 == ch)
    split = F.when(F.col("conv_id") % 2 == 1, F.array(of(0), of(1))).otherwise(F.array("codes"))
    c = t.select("conv_id", "turn", F.posexplode(split).alias("channel", "codes")).withColumn("channel", F.col("channel").cast("bigint"))
    out = adpcm_track(c, ["conv_id", "channel"], "turn", "codes", "escape").where(F.size("codes") > 0)
    return out.select("conv_id", "turn", "channel", "sample", "step", *_sums(F.col("samples")))


@query(
    "wrapped_frames",
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n, 4 * (turn % 5) AS pad, strlen(coalesce(text, '')) = 0 OR conv_id % 6 = 5 AND turn = 2 AS bad FROM conversations),
p AS (SELECT *, coalesce(sum(pad + 16 + n) OVER w, 0) AS before, coalesce(bool_or(bad) OVER (PARTITION BY conv_id ORDER BY turn), false) AS ended, sum(pad + 16 + n) OVER (PARTITION BY conv_id) - CASE WHEN conv_id % 6 = 4 THEN 3 ELSE 0 END AS total,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(k AS BIGINT) AS frame_no, CAST(before + pad + 16 AS BIGINT) AS "offset", CAST(n AS BIGINT) AS size, md5(text) AS digest FROM p WHERE NOT ended AND before + pad + 16 + n <= total""",
)
def wrapped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of payloads in wrappers, of one kind for even and another for odd conversations, up to the first bad wrapper."""
    extra = F.when(F.col("conv_id") % 2 == 0, 12).otherwise(28)
    size = F.when((F.col("conv_id") % 6 == 5) & (F.col("turn") == 2), 5).otherwise(F.octet_length("body") + extra)
    wrapper = F.concat(F.unhex(F.repeat(F.lit("00000000"), (F.col("turn") % 5).cast("int"))), _le(size), F.unhex(F.lit("AA" * 12)), F.col("body"))
    payloads = _joined(turns(spark, sf_dir), wrapper, "payload")
    payloads = payloads.withColumn("payload", F.substring(F.col("payload"), F.lit(1), F.octet_length("payload") - F.when(F.col("conv_id") % 6 == 4, 3).otherwise(0)))
    fields = {"offset": "bigint", "body": "binary"}
    found = [walked(payloads.where(F.col("conv_id") % 2 == k), "payload", wrapped(kind), fields, "frame_no") for k, kind in enumerate(("moviefs", "videofs"))]
    return found[0].union(found[1]).select("conv_id", "frame_no", "offset", F.octet_length("body").cast("bigint").alias("size"), F.md5("body").alias("digest"))


#: Pictures of a file, and a picture's sides.
FILE, SIDE = 16, 8


@query(
    "raw_frames",
    f"""WITH p AS (SELECT vec_id // {FILE} AS movie, vec_id % {FILE} AS k, k3, CAST(greatest(0, least(63, floor((v::DOUBLE + 1.0) * 32.0))) AS BIGINT) AS y FROM (SELECT vec_id, unnest(range(len(embedding))) AS k3, unnest(embedding) AS v FROM embeddings)),
f AS (SELECT movie, k, sum(y + y % 32 + 31 - y % 32) AS total, sum(y * (3 * k3 + 1) + (y % 32) * (3 * k3 + 2) + (31 - y % 32) * (3 * k3 + 3)) AS placed FROM p GROUP BY movie, k),
n AS (SELECT *, row_number() OVER (PARTITION BY movie ORDER BY k) - 1 AS frame_no FROM f)
SELECT CAST(movie AS BIGINT) AS movie, CAST(frame_no AS BIGINT) AS frame_no, 'ok' AS status, CAST(total AS BIGINT) AS total, CAST(placed AS BIGINT) AS placed FROM n
UNION ALL SELECT CAST(movie AS BIGINT), CAST(count(*) AS BIGINT), 'partial', NULL, NULL FROM n WHERE movie % 3 = 1 GROUP BY movie""",
)
def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written to files of {FILE}, some with part of a picture behind them, and read back by byte ranges."""
    y = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(63), F.floor((v.cast("double") + 1.0) * 32.0))).cast("bigint"))
    pixels = F.flatten(F.transform(y, lambda v: F.array(v, v % 32, 31 - v % 32)))
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / FILE).cast("bigint").alias("movie"), (F.col("vec_id") % FILE).alias("k"), _hexed(pixels).alias("body"))
    rest = e.where("movie % 3 = 1").select("movie").distinct().select("movie", F.lit(FILE).cast("bigint").alias("k"), F.unhex(F.lit("7F" * 100)).alias("body"))
    path = scratch(spark, "raw-frames")
    write_files(e.unionByName(rest), path, F.format_string("movie-%d", "movie"), [F.col("k")], F.col("body"))
    got = read_frames(spark, path, SIDE, SIDE, partition_bytes=5 * SIDE * SIDE * 3)
    _, total, placed = _sums(bits.byte_values(F.col("frame")))
    whole = F.col("frame").isNotNull()
    return got.select(F.regexp_extract("file", r"(\d+)$", 1).cast("bigint").alias("movie"), "frame_no", "status", F.when(whole, total).alias("total"), F.when(whole, placed).alias("placed"))


#: A chunk's palette: a marker and 256 words, five bits a colour, red lowest.
MARKER, PREFIX = "FFFFFFFF", 1028


def palette_prefix(payload: Column) -> Column:
    """The palette before a payload as 768 bytes of red, green and blue; null without one."""
    has = (F.octet_length(payload) >= PREFIX) & (F.hex(F.substring(payload, 1, 4)) == MARKER)
    # the colours of one row in one expression, so that words are cut once
    five = lambda w, k: F.shiftright(w, 5 * k).bitwiseAND(F.lit(31).cast("bigint"))
    eight = lambda v: F.shiftleft(v, 3) + F.shiftright(v, 2)
    words = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: bits.word_at(payload, 4 + 4 * k, 2))
    return F.when(has, _hexed(F.flatten(F.transform(words, lambda w: F.array(*[eight(five(w, k)) for k in range(3)])))))


@query(
    "inline_palettes",
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id + turn) % 3 = 0 AS has FROM conversations),
a AS (SELECT conv_id, turn, text, max(CASE WHEN has THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS own FROM t),
px AS (SELECT conv_id, turn, own, k, CAST(strpos('123456789ABCDEF', hex(encode(text))[2 * k - 1]) * 16 + strpos('123456789ABCDEF', hex(encode(text))[2 * k]) AS BIGINT) AS i FROM (SELECT *, unnest(range(1, strlen(text) + 1)) AS k FROM a)),
w AS (SELECT conv_id, turn, own, (conv_id * 31 + own * 1009 + i * 727) % 32768 AS w FROM px),
c AS (SELECT conv_id, turn, own, (w % 32) * 8 + (w % 32) // 4 AS r, ((w // 32) % 32) * 8 + ((w // 32) % 32) // 4 AS g, (w // 1024) * 8 + (w // 1024) // 4 AS b FROM w)
SELECT conv_id, turn, CAST(count(*) AS BIGINT) AS pixels, CAST(sum(r) AS BIGINT) AS red, CAST(sum(g) AS BIGINT) AS green, CAST(sum(b) AS BIGINT) AS blue FROM c GROUP BY conv_id, turn""",
)
def inline_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of indexed pixels, some with a palette before them that holds until the next: sums of their colours, null before the first."""
    word = lambda k: (F.col("conv_id") * 31 + F.col("turn") * 1009 + k * 727) % 32768
    table_of = F.concat(F.unhex(F.lit(MARKER)), _hexed(F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint")), lambda k: F.array(word(k) % 256, F.floor(word(k) / 256).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))))))
    chunks = turns(spark, sf_dir).select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(table_of, F.col("body"))).otherwise(F.col("body")).alias("payload"))
    return palettes_applied(chunks, ["conv_id"], "turn", "payload").where("pixels > 0").select("conv_id", "turn", "pixels", *[(F.col("sums")[k]).alias(n) for k, n in enumerate(("red", "green", "blue"))])


def palettes_applied(chunks: DataFrame, keys: list[str], order: str, payload: str) -> DataFrame:
    """``chunks`` with ``pixels``, the number of indices behind a palette if there is one, and ``sums`` of their red, green and blue.

    The palette of a chunk without one is the last before it, found by a scan that hands palettes on, so neither a movie
    nor a palette's chunks meet in one task.
    """
    own = chunks.withColumn("_palette", palette_prefix(F.col(payload)))
    state = F.struct(F.col("_palette").alias("p"))
    late = lambda a, b: F.struct(F.coalesce(b["p"], a["p"]).alias("p"))
    own = prefix_scan(own, keys, order, state, late, F.struct(F.lit(None).cast("binary").alias("p")), "_before")
    held = F.coalesce(F.col("_palette"), F.col("_before.p"))
    pixels = F.when(F.col("_palette").isNotNull(), F.substring(F.col(payload), F.lit(PREFIX + 1), F.octet_length(payload))).otherwise(F.col(payload))
    own = own.select("*", F.explode(F.array(F.struct(bits.byte_values(pixels).alias("i"), F.when(held.isNotNull(), bits.byte_values(held)).alias("c")))).alias("_x"))
    colour = lambda k: F.aggregate("_x.i", F.lit(0).cast("bigint"), lambda s, i: s + F.col("_x.c")[(3 * i + k).cast("int")])
    sums = [colour(k) for k in range(3)]
    return own.withColumn("pixels", F.size("_x.i").cast("bigint")).withColumn("sums", F.array(*sums)).drop("_palette", "_before", "_x")


#: Frames a second of written movies, their samples a second, and bytes of a piece of sound.
FPS, RATE, PIECE = (2, 1), 101, 64
_HEAD_SQL = """'ARMovie' || chr(10) || 'movie ' || conv_id || chr(10) || 'c' || chr(10) || chr(10) || '19 video format' || chr(10) || '8 pixels' || chr(10) || '8 pixels' || chr(10) || '16 bits per pixel' || chr(10) || '2 frames per second' || chr(10)
 || '1 sound format' || chr(10) || '101 Hz samples' || chr(10) || '1 channels' || chr(10) || '8 bits per sample' || chr(10) || shown || ' frames per chunk' || chr(10) || (chunks - 1) || ' number of chunks' || chr(10) || even || ' even chunk size' || chr(10) || odd || ' odd chunk size' || chr(10)"""
_TAIL = "0 offset to sprite\n0 size of sprite\n-1 (no keys)\n"


@query(
    "movie_files",
    f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS f, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n, count(*) OVER (PARTITION BY conv_id) AS cnt FROM conversations),
r AS (SELECT *, CASE WHEN conv_id % 3 = 0 AND cnt >= 2 AND cnt <= 8 THEN cnt WHEN conv_id % 3 = 0 THEN 8 ELSE 3 END AS p, CASE WHEN conv_id % 3 = 0 AND (cnt < 2 OR cnt > 8) THEN 1 ELSE 2 END AS q FROM t),
c AS (SELECT conv_id, ((f + 1) * q - 1) // p AS chunk, min(f) AS first, count(*) AS k, sum(n) + sum(n) % 2 AS video, any_value(p) AS p, any_value(q) AS q, string_agg(text, '' ORDER BY f) AS text FROM r GROUP BY conv_id, ((f + 1) * q - 1) // p),
s AS (SELECT *, (2 * first * 101 + 2) // 4 AS s0, (2 * (first + k) * 101 + 2) // 4 AS s1 FROM c),
b AS (SELECT *, video + s1 - s0 AS size, sum((video + s1 - s0 + 2047) // 2048 * 2048) OVER (PARTITION BY conv_id ORDER BY chunk) - (video + s1 - s0 + 2047) // 2048 * 2048 AS before FROM s),
m AS (SELECT conv_id, count(*) AS chunks, coalesce(max(size + 1) FILTER (chunk % 2 = 0), 0) AS even, coalesce(max(size + 1) FILTER (chunk % 2 = 1), 0) AS odd, CASE WHEN max(k) > any_value(p) / any_value(q) THEN CAST(max(k) AS VARCHAR) WHEN any_value(p) % any_value(q) = 0 THEN CAST(any_value(p) // any_value(q) AS VARCHAR) ELSE CAST(any_value(p) // any_value(q) AS VARCHAR) || '.5' END AS shown FROM b GROUP BY conv_id),
h AS (SELECT *, len({_HEAD_SQL}) + 3 + {len(" catalogue offset") + 1 + len(_TAIL)} AS cat FROM m),
d AS (SELECT *, (cat + chunks * 30 + 2047) // 2048 * 2048 AS data FROM h),
w AS (SELECT conv_id, hex(encode(string_agg(text, '' ORDER BY f))) AS h, strlen(string_agg(text, '')) AS n FROM t GROUP BY conv_id)
SELECT b.conv_id AS movie, CAST(chunk AS BIGINT) AS chunk, CAST(data + before AS BIGINT) AS file_offset, CAST(video AS BIGINT) AS video_bytes, CAST(s1 - s0 AS BIGINT) AS sound_bytes, true AS ok,
 md5(hex(encode(b.text)) || CASE WHEN strlen(b.text) % 2 = 1 THEN '00' ELSE '' END) AS video, md5(substr(w.h, 2 * s0 + 1, 2 * (s1 - s0)) || repeat('00', CAST(greatest(0, s1 - greatest(s0, w.n)) AS BIGINT))) AS sound
FROM b JOIN d USING (conv_id) JOIN w USING (conv_id)""",
)
def movie_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as movie files with sound, and read back: every chunk's place, sizes and bytes."""
    from pyspark.sql import Window

    from filmloom.sources.movie_sink import write_movies
    from filmloom.sources.movies import files

    t = turns(spark, sf_dir)
    # turns of a conversation, which is one of a bounded size, counted from 0
    f = t.select(F.col("conv_id").alias("movie"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("bigint") - 1).alias("frame_no"), "body")
    track = _joined(t, F.col("body"), "sound").where(F.octet_length("sound") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.octet_length("sound") - 1, F.lit(PIECE)), lambda at: F.substring(F.col("sound"), at + 1, F.lit(PIECE)))
    sound = track.select(F.col("conv_id").alias("movie"), F.posexplode(pieces).alias("piece", "body")).withColumn("piece", F.col("piece").cast("bigint"))
    own = {"title": F.concat(F.lit("movie "), F.col("movie").cast("string")), "copyright": F.lit("c"), "author": F.lit(""), "video_codec": F.lit(19), "width": F.lit(8), "height": F.lit(8), "pixel_depth": F.lit(16), "frames_per_second": F.lit(FPS[0]), "sound_codec": F.lit(1), "sound_rate": F.lit(RATE), "sound_channels": F.lit(1), "sound_precision": F.lit(8)}
    eight = F.col("movie") % 3 == 0
    m = f.select("movie").distinct().select("movie", F.when(eight, 8).otherwise(3).alias("p"), F.when(eight, 1).otherwise(2).alias("q"), F.struct(*[c.alias(n) for n, c in own.items()]).alias("fields"))
    path = scratch(spark, "movies")
    write_movies(f, sound, m, path, FPS, RATE, 1, PIECE)
    from filmloom.operators.layout import read_movies

    there = files(spark, path).withColumn("path", F.regexp_extract("path", r"(\d+)$", 1))
    found = read_movies(there).join(there.select("path", "content"), "path")
    cut = lambda at, n: F.md5(F.encode(F.hex(F.substring(F.col("content"), (at + 1).cast("int"), n.cast("int"))), "US-ASCII"))
    return found.select(F.col("path").cast("bigint").alias("movie"), F.col("chunk_no").alias("chunk"), "file_offset", "video_bytes", "sound_bytes", "ok", cut(F.col("file_offset"), F.col("video_bytes")).alias("video"), cut(F.col("file_offset") + F.col("video_bytes"), F.col("sound_bytes")).alias("sound"))
