"""Queries on streams of codes and packets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.operators.bitstream import LUMA_CODES, code_bits, read_codes, strict_end, strings, write_codes
from filmloom.plans.films import turns
from filmloom.plans.registry import query
from filmloom.sources.scratch import kept

#: Bytes of a chunk that is read apart from others.
CHUNK = 48
_TEXT_SQL = "t AS (SELECT conv_id, turn, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM conversations)"
_CODES_SQL = f"""{_TEXT_SQL}, s AS (SELECT conv_id, turn, i, CAST((instr('123456789ABCDEF', h[2 * i + 1]) * 16 + instr('123456789ABCDEF', h[2 * i + 2])) & 63 AS BIGINT) AS symbol FROM (SELECT *, unnest(range(strlen(text))) AS i FROM t)),
c AS (SELECT *, ({strings(LUMA_CODES)})[symbol + 1] AS code, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS place FROM s),
o AS (SELECT *, sum(len(code)) OVER (PARTITION BY conv_id ORDER BY place) - len(code) AS pos FROM c)"""


def _six_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = b.column(2)
        _, offsets, data = own.buffers()
        low = np.frombuffer(data, np.uint8) & 63 if data else np.zeros(0, np.uint8)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.Array.from_buffers(own.type, len(own), [None, offsets, pa.py_buffer(low)], offset=own.offset)], ["conv_id", "turn", "symbols"])


def code_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, n, used_bits, payload): the low six bits of a conversation's bytes as one stream of codes."""
    t = turns(spark, sf_dir).select("conv_id", "turn", "body")
    t = t.mapInArrow(_six_bits, t.withColumnRenamed("body", "symbols").schema)
    pieces = write_codes(t, ["conv_id"], "turn", "symbols", LUMA_CODES)
    used = code_bits(t, ["conv_id"], "turn", "symbols", LUMA_CODES).groupBy("conv_id").agg(F.sum("_n").alias("n"), F.sum("_bits").alias("used_bits"))
    return kept(pieces.groupBy("conv_id").agg(F.expr("listagg(body, X'') WITHIN GROUP (ORDER BY at)").alias("payload")).join(used, "conv_id"), "code-payloads")


@query(
    "code_bytes",
    f"""WITH {_CODES_SQL}, b AS (SELECT conv_id, count(*) AS n, string_agg(code, '' ORDER BY place) AS bits FROM o GROUP BY conv_id),
y AS (SELECT conv_id, n, len(bits) AS used, list_transform(range((len(bits) + 7) // 8), lambda k: list_sum(list_transform(range(8), lambda j: CASE WHEN bits[8 * k + j + 1] = '1' THEN 1 << j ELSE 0 END))) AS bytes FROM b)
SELECT conv_id, CAST(n AS BIGINT) AS n, CAST(used AS BIGINT) AS used_bits, CAST(len(bytes) AS BIGINT) AS size, md5(array_to_string(list_transform(bytes, lambda v: printf('%02X', CAST(v AS INTEGER))), '')) AS digest FROM y""",
)
def code_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of residual codes as bytes, written turn by turn: symbols, bits, bytes and the digest of their hex."""
    p = code_payloads(spark, sf_dir)
    return p.select("conv_id", "n", "used_bits", F.octet_length("payload").cast("bigint").alias("size"), F.md5(F.encode(F.hex("payload"), "US-ASCII")).alias("digest"))


@query(
    "code_symbols",
    f"""WITH {_CODES_SQL}, k AS (SELECT conv_id, pos // {8 * CHUNK} AS chunk, symbol, row_number() OVER (PARTITION BY conv_id, pos // {8 * CHUNK} ORDER BY place) AS p, pos FROM o)
SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, CAST(min(pos) - chunk * {8 * CHUNK} AS BIGINT) AS skip, CAST(count(*) AS BIGINT) AS n, CAST(sum(symbol * p) AS BIGINT) AS placed FROM k GROUP BY conv_id, chunk""",
)
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same streams read back in chunks of bytes, each from the place where the codes of the one before it end."""
    part = lambda at, n: F.substring(F.col("payload"), at + 1, F.lit(n))
    cuts = F.transform(F.sequence(F.lit(0), F.octet_length("payload") - 1, F.lit(CHUNK)), lambda at: F.struct(part(at, CHUNK).alias("body"), part(at + CHUNK, 2).alias("ahead")))
    c = code_payloads(spark, sf_dir).select("conv_id", "used_bits", F.posexplode(cuts).alias("chunk", "x")).withColumn("chunk", F.col("chunk").cast("bigint"))
    # padding may look like codes: none begins beyond the stream's bits
    c = c.select("conv_id", "chunk", "x.body", "x.ahead", F.least(F.lit(8 * CHUNK), F.col("used_bits") - F.col("chunk") * 8 * CHUNK).alias("used"))

    def placed(symbols: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum(counts)
        nth = np.arange(1, len(symbols) + 1) - np.repeat(ends - counts, counts)
        total = np.concatenate([[0], np.cumsum(symbols * nth)])
        return [counts, total[ends] - total[ends - counts]]

    r = read_codes(c, ["conv_id"], "chunk", "body", LUMA_CODES, "ahead", "used", (["n", "placed"], placed))
    return r.where("n > 0").select("conv_id", "chunk", F.col("skip").cast("bigint").alias("skip"), "n", "placed")


@query(
    "code_ends",
    f"""WITH {_CODES_SQL}, b AS (SELECT conv_id, sum(len(code)) AS used FROM o GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 5 = 3 THEN 'trailing bytes' WHEN conv_id % 5 = 4 AND used % 8 <> 0 THEN 'non-zero padding' WHEN conv_id % 5 = 2 THEN 'truncated' ELSE 'ok' END AS status FROM b""",
)
def code_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict ends of streams, some of them with a byte too many or too few or with a bit set behind the last code."""
    p, size = code_payloads(spark, sf_dir), F.octet_length("payload")
    last = F.conv(F.hex(F.substring(F.col("payload"), size, F.lit(1))), 16, 10).cast("bigint").bitwiseOR(F.lit(128).cast("bigint"))
    cut = F.substring(F.col("payload"), F.lit(1), size - 1)
    kind = F.col("conv_id") % 5
    spoiled = F.when(kind == 3, F.concat("payload", F.unhex(F.lit("00")))).when((kind == 4) & (F.col("used_bits") % 8 != 0), F.concat(cut, F.unhex(F.lpad(F.hex(last), 2, "0")))).when(kind == 2, cut).otherwise(F.col("payload"))
    return p.select("conv_id", strict_end(spoiled, F.col("used_bits")).alias("status"))


#: Movies that documents are dealt to as frames.
MOVIES = 4


def _varint_sql(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"


_MUX_SQL = f"""f AS (SELECT doc_id % {MOVIES} AS movie, row_number() OVER (PARTITION BY doc_id % {MOVIES} ORDER BY doc_id) - 1 AS frame_no, doc_id, doc_id % 3 AS stream, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT *, 1 + 2 + {_varint_sql("stream")} + ({_varint_sql("(doc_id + 128)")}) + ({_varint_sql("n")}) + 4 + n AS size, doc_id * 3 + stream AS stamp FROM f),
w AS (SELECT movie, -1::BIGINT AS frame_no, 0::BIGINT AS pos, -1::BIGINT AS last, false AS synced, 0::BIGINT AS back, 0::BIGINT AS sync_bytes, 0::BIGINT AS begins FROM g WHERE frame_no = 0
UNION ALL SELECT movie, frame_no, pos + s + size, CASE WHEN due THEN pos ELSE last END, due, CASE WHEN due THEN back ELSE 0 END, s, pos + s FROM
 (SELECT *, CASE WHEN due THEN 8 + ({_varint_sql("(body + 4)")}) + body + 4 ELSE 0 END AS s FROM (SELECT *, ({_varint_sql("stamp")}) + ({_varint_sql("back")}) AS body FROM
 (SELECT g.movie, g.frame_no, size, stamp, pos, last, last < 0 OR pos - last >= 65536 AS due, CASE WHEN last < 0 THEN 0 ELSE (pos - last) // 16 END AS back FROM w JOIN g ON g.movie = w.movie AND g.frame_no = w.frame_no + 1))))"""


def muxed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames of movies with three streams: movie, frame_no, size and stamp."""
    from pyspark.sql import Window

    from filmloom.operators.mux import frame_size
    from filmloom.plans.registry import table

    # numbering only needs ids: a movie's frames in order
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n"))
    d = d.withColumn("movie", F.col("doc_id") % MOVIES).withColumn("frame_no", F.row_number().over(Window.partitionBy("movie").orderBy("doc_id")).cast("bigint") - 1)
    stream = F.col("doc_id") % 3
    return d.select("movie", "frame_no", frame_size(stream, F.col("doc_id"), F.lit(False), F.col("n")).alias("size"), (F.col("doc_id") * 3 + stream).alias("stamp"))


@query("sync_points", f"WITH RECURSIVE {_MUX_SQL} SELECT movie, frame_no, CAST(back AS BIGINT) AS back, CAST(sync_bytes AS BIGINT) AS sync_bytes FROM w WHERE synced")
def sync_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync points of muxed movies, a byte distance apart that their own sizes change, found without walking through the frames."""
    from filmloom.operators import mux

    return mux.sync_points(muxed_frames(spark, sf_dir), "movie", "frame_no", "size", "stamp").drop("before")


@query("muxed_layout", f"WITH RECURSIVE {_MUX_SQL} SELECT movie, frame_no, synced, CAST(begins AS BIGINT) AS \"at\" FROM w WHERE frame_no >= 0")
def muxed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every frame of the muxed movies begins behind the headers, and whether a sync point stands before it."""
    from filmloom.operators import mux

    f = muxed_frames(spark, sf_dir)
    return mux.layout(f, mux.sync_points(f, "movie", "frame_no", "size", "stamp"), "movie", "frame_no", "size").select("movie", "frame_no", "synced", "at")
