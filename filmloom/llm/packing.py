"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the longest length, and what is left into one piece for each bit of its
binary length, longest first. Every piece is a sequence by itself and lies in the bucket of its length: a batch takes
sequences of one bucket, nothing is padded and no sequence crosses documents.

Texts are tokenised once, where they are read, and the pieces written with the partition that cut them and their place
in that partition's buckets. Sequences are then numbered by the pieces that other partitions have before, so neither
texts nor ids are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.llm._shared import written
from filmloom.llm._tokens import ByteBPE, byte_bpe, safe_cuts

#: Text bytes tokenised at once, and bytes of ids in a batch of pieces.
STEP, BATCH = 1 << 20, 1 << 22


def lengths(n: int, longest: int) -> list[int]:
    """The pieces of a document of ``n`` tokens: as many of the longest as fit, then a power of two for each bit that is left."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def token_ids(bpe: ByteBPE, text: str | None, end_id: int) -> np.ndarray:
    """The ids of a whole text, some of it at a time, and the end's."""
    if text and len(text) > STEP:
        blob = text.encode()
        cuts = [0, *safe_cuts(blob, STEP).tolist(), len(blob)]
        parts = [bpe.ids(blob[a:b].decode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    else:
        parts = [bpe.ids(text)] if text else []
    return np.concatenate([*parts, [end_id]]).astype("<u4")


def packed(docs: DataFrame, path: str, longest: int = 2048, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The pieces of all documents: ``id_col``, start, length, ids, doc_tokens, sequence_id, offset, padded_length.

    ``ids`` are little-endian unsigned 32-bit integers. ``start`` is the piece's first token in its document, whose length
    with the end is ``doc_tokens``. Sequence numbers run without gaps from 0, bucket after bucket, longest first; within a
    bucket they follow the partitions that were read. A sequence is one piece, so ``offset`` is 0 and the padded length is
    the piece's own.

    A null or empty text is one token, its end. A text of any length is cut whole; repeated rows and rows without an id are
    documents of their own; an empty table has no pieces; other columns are left out, whatever their names.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    kind = own.schema["i"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, places = byte_bpe(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows, size = [], 0
            for r in range(b.num_rows):
                ids = token_ids(bpe, b.column("t")[r].as_py(), end_id)
                blob, start = ids.tobytes(), 0
                for n in lengths(len(ids), longest):
                    rows.append((r, start, n, blob[4 * start : 4 * (start + n)], len(ids), places[n]))
                    places[n] += 1
                    start += n
                    size += 4 * n
                    if size >= BATCH:
                        yield _batch(b, part, rows)
                        rows, size = [], 0
            yield _batch(b, part, rows)

    pieces = written(own.mapInArrow(cut, f"i {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, place bigint, part int"), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a length: a dozen
    longer = counts.groupBy("length").agg(F.sum("n").alias("n"))
    longer = longer.select("length", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(F.broadcast(longer), "length")
    first = written(first.select("length", "part", (F.col("base") + F.col("before")).alias("first")), "piece-numbers")
    out = pieces.join(first, ["length", "part"])
    return out.select(
        F.col("i").alias(id_col), "start", "length", "ids", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("padded_length"),
    )


def _batch(b: pa.RecordBatch, part: int, rows: list[tuple]) -> pa.RecordBatch:
    at, start, n, ids, total, place = zip(*rows, strict=True) if rows else ((),) * 6
    columns = [b.column("i").take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(place, pa.int64()), pa.array([part] * len(rows), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["i", "start", "length", "ids", "doc_tokens", "place", "part"])
