"""Streams of prefix codes as bytes, the lowest bit first, written and read in chunks apart from each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmloom.operators.scan import states_before
from filmloom.sources.scratch import kept

#: The codes of six-bit luma residuals, by residual, as (bits, length); the lowest bit is written first.
LUMA_CODES = [
    (0x002, 2), (0x007, 3), (0x00D, 4), (0x019, 5), (0x01C, 5), (0x018, 5), (0x031, 6), (0x034, 6), (0x030, 6), (0x061, 7), (0x06C, 7), (0x050, 7), (0x0C1, 8), (0x0CC, 8), (0x0E8, 8), (0x1A1, 9),
    (0x18C, 9), (0x1D4, 9), (0x194, 9), (0x190, 9), (0x2A1, 10), (0x341, 10), (0x34C, 10), (0x294, 10), (0x314, 10), (0x541, 11), (0x141, 11), (0x68C, 11), (0x54C, 11), (0x14C, 11), (0x494, 11), (0x614, 11),
    (0x690, 11), (0x290, 11), (0x710, 11), (0x310, 11), (0x414, 11), (0x014, 11), (0x214, 11), (0x094, 11), (0x28C, 11), (0x090, 10), (0x110, 10), (0x114, 10), (0x08C, 10), (0x0A1, 10), (0x010, 9), (0x0D4, 9),
    (0x04C, 9), (0x041, 9), (0x068, 8), (0x054, 8), (0x00C, 8), (0x021, 8), (0x028, 7), (0x02C, 7), (0x001, 7), (0x008, 6), (0x011, 6), (0x000, 5), (0x004, 5), (0x009, 5), (0x005, 4), (0x003, 3),
]


def strings(codes: list[tuple[int, int]]) -> list[str]:
    """Codes as digits in the order in which they are written. Raises a ValueError unless they are a complete prefix code."""
    out = [format(v, f"0{n}b")[::-1] for v, n in codes]
    order = sorted(out)
    if any(len(s) != n for s, (_, n) in zip(out, codes, strict=True)) or any(b.startswith(a) for a, b in zip(order, order[1:], strict=False)) or sum(2.0**-n for _, n in codes) != 1:
        raise ValueError("not a complete prefix code")
    return out


#: Bytes of chunks that are read at once, and symbols that are written at once; a longer chunk is taken alone.
AT_ONCE, WRITTEN_AT_ONCE = 1 << 18, 1 << 20


def _fields(d: DataFrame, columns: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*[d.schema[c] for c in columns], *[T.StructField(n, kind) for n, kind in more]])


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in runs of at most about ``WRITTEN_AT_ONCE`` symbols: numbers made of them take many times their room."""
    for b in batches:
        length = pc.binary_length if pa.types.is_binary(b.column(column).type) or pa.types.is_large_binary(b.column(column).type) else pc.list_value_length
        step = max(1, WRITTEN_AT_ONCE // (pc.max(length(b.column(column))).as_py() or 1))
        for a in range(0, b.num_rows, step):
            yield b.slice(a, step)


def _flat_symbols(column: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a batch one behind the other, and where each chunk's begin. Raises a ValueError at one without a code."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        values, offsets = column.flatten(), np.asarray(column.offsets)
        bad = values.null_count
        values = np.asarray(values.fill_null(0))
        offsets = offsets - offsets[0]
    else:
        (values, offsets), bad = _flat_bytes(column), 0
        values, offsets = values[offsets[0] : offsets[-1]], offsets - offsets[0]
    if bad or column.null_count or len(values) and not 0 <= values.min() <= values.max() < most:
        raise ValueError("a symbol without a code")
    return values, offsets


def _flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data, np.uint8))])


def code_bits(chunks: DataFrame, keys: list[str], order: str, symbols: str, codes: list[tuple[int, int]]) -> DataFrame:
    """keys, ``order``, symbols as ``_n`` and their bits as ``_bits`` of each chunk; ``symbols`` is an array of numbers or a binary of bytes."""
    lengths, wide = np.array([n for _, n in codes]), len(keys) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, wide):
            values, offsets = _flat_symbols(b.column(wide), len(codes))
            ends = np.concatenate([[0], np.cumsum(lengths[values])])
            yield pa.RecordBatch.from_arrays([*b.columns[:wide], pa.array(np.diff(offsets).astype(np.int64)), pa.array(np.diff(ends[offsets]).astype(np.int64))], [*keys, order, "_n", "_bits"])

    return chunks.select(*keys, order, symbols).mapInArrow(counted, _fields(chunks, [*keys, order], ("_n", T.LongType()), ("_bits", T.LongType())))


def write_codes(chunks: DataFrame, keys: list[str], order: str, symbols: str, codes: list[tuple[int, int]]) -> DataFrame:
    """The bytes of each stream in pieces: keys, at (the first byte's place), body. A stream's end is filled with zero bits.

    ``symbols`` is an array of numbers or a binary of bytes. A chunk's place is the sum of the bits before it, so chunks are
    written apart from each other; a byte that several of them touch is put together from what each sets in it. A null
    symbol, or one without a code, is an error.
    """
    strings(codes)
    own, lengths, wide = np.array([v for v, _ in codes]), np.array([n for _, n in codes]), len(keys)
    add = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"))
    start = states_before(code_bits(chunks, keys, order, symbols, codes), keys, order, F.struct(F.col("_bits").alias("n")), add, F.struct(F.lit(0).cast("bigint").alias("n")), "_at")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches, wide):
            values, offsets = _flat_symbols(b.column(wide), len(codes))
            at = np.asarray(b.column(wide + 1))
            ends = np.concatenate([[0], np.cumsum(lengths[values])])
            bits, lead = np.diff(ends[offsets]), at % 8
            size = np.where(bits > 0, (lead + bits + 7) // 8, 0)
            begin = np.cumsum(size) - size
            place = ends[:-1] + np.repeat(8 * begin + lead - ends[offsets[:-1]], np.diff(offsets))
            v, k, total = own[values] << (place & 7), place >> 3, int(size.sum())
            data = np.zeros(total + 3)
            for j in range(3):  # no two codes set the same bit, so sums are what is set
                data += np.bincount(k + j, (v >> 8 * j) & 255, total + 3)
            data = data.astype(np.uint8)
            edge = np.zeros(total + 3, bool)
            some, more, inside = np.flatnonzero(size > 0), np.flatnonzero(size > 1), np.flatnonzero(size > 2)
            first, last = begin[some], begin[more] + size[more] - 1
            edge[first] = edge[last] = edge[total:] = True
            rows = pa.array(np.concatenate([some, more, inside]))
            where = np.concatenate([at[some] // 8, at[more] // 8 + size[more] - 1, at[inside] // 8 + 1])
            byte = pa.concat_arrays([pa.array(data[np.concatenate([first, last])].astype(np.int64)), pa.nulls(len(inside), pa.int64())])
            body = pa.concat_arrays([pa.nulls(len(some) + len(more), pa.binary()), _binary(data[~edge], size[inside] - 2)])
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in b.columns[:wide]], pa.array(where), byte, body], [*keys, "at", "_byte", "body"])

    c = chunks.select(*keys, order, symbols).join(start, [*keys, order]).select(*keys, symbols, F.col("_at.n").alias("_at"))
    w = kept(c.mapInArrow(written, _fields(chunks, keys, ("at", T.LongType()), ("_byte", T.LongType()), ("body", T.BinaryType()))), "code-pieces")
    ends = w.where(F.col("_byte").isNotNull()).groupBy(*keys, "at").agg(F.bit_or("_byte").alias("_byte"))
    return w.where(F.col("_byte").isNull()).select(*keys, "at", "body").union(ends.select(*keys, "at", F.unhex(F.lpad(F.hex("_byte"), 2, "0")).alias("body")))


def _lookup(codes: list[tuple[int, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    """The longest code, and by that many next bits the symbol and length of the code that they begin with."""
    most = max(n for _, n in codes)
    symbol, length = np.zeros(1 << most, np.int64), np.zeros(1 << most, np.int64)
    for s, (v, n) in enumerate(codes):
        symbol[v :: 1 << n], length[v :: 1 << n] = s, n
    return most, symbol, length


def _lanes(bodies: pa.Array, ahead: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks in runs of about ``AT_ONCE`` bytes: their rows, the 24 bits from each byte on, places by chunks, and the bits of chunks and of all that is there."""
    (data, begin), (data2, begin2) = _flat_bytes(bodies), _flat_bytes(ahead)
    size, size2 = np.diff(begin), np.diff(begin2)
    step = max(1, AT_ONCE // max(1, int(size.max(initial=0))))
    for a in range(0, len(size), step):
        rows = slice(a, min(a + step, len(size)))
        n, most = rows.stop - a, int(size[rows].max())
        b = np.zeros((most + 5, n), np.int64)
        for flat, offsets, sizes, behind in ((data, begin, size[rows], 0), (data2, begin2, size2[rows], size[rows])):
            lane = np.repeat(np.arange(n), sizes)
            place = np.arange(len(lane)) - np.repeat(np.cumsum(sizes) - sizes - behind, sizes)
            b[place, lane] = flat[offsets[a] : offsets[rows.stop]]
        yield rows, b[:-2] | b[1:-1] << 8 | b[2:] << 16, 8 * size[rows], 8 * (size[rows] + size2[rows])


def _overs(words: np.ndarray, own: np.ndarray, most: int, length: np.ndarray) -> np.ndarray:
    """By the place where a chunk's first code begins and by chunk: the bits that its last code takes of the next."""
    bits, n = int(own.max()), words.shape[1]
    mixed = own.min() < bits
    over = np.maximum(0, np.arange(bits + most)[:, None] - own).astype(np.int16)
    flat, lane, far = over.reshape(-1), np.arange(n), length * n
    w, to = np.empty(n, np.int64), np.empty(n, np.int16)
    for b in range(bits - 1, -1, -1):
        np.right_shift(words[b >> 3], b & 7, out=w)
        np.bitwise_and(w, (1 << most) - 1, out=w)
        k = far[w]
        k += lane
        np.take(flat, np.add(k, b * n, out=k), out=to, mode="clip")
        over[b] = np.where(b < own, to, over[b]) if mixed else to
    return over[:most]


def _symbols(words: np.ndarray, skip: np.ndarray, own: np.ndarray, there: np.ndarray, most: int, symbol: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes that begin in each chunk from ``skip`` on, one chunk's behind the other's, and how many each has."""
    n, flat = words.shape[1], words.reshape(-1)
    lane = np.flatnonzero(skip < own)
    at, count, found = skip[lane], np.zeros(n, np.int64), []
    while len(lane):
        w = (flat[(at >> 3) * n + lane] >> (at & 7)) & ((1 << most) - 1)
        at = at + length[w]
        whole = at <= there[lane]
        if not whole.all():
            lane, at, w = lane[whole], at[whole], w[whole]
        found.append((lane, symbol[w]))
        count[lane] += 1
        left = at < own[lane]
        lane, at = lane[left], at[left]
    out, begin = np.empty(int(count.sum()), np.int64), np.cumsum(count) - count
    for k, (lane, s) in enumerate(found):
        out[begin[lane] + k] = s
    return out, count


def read_codes(
    chunks: DataFrame, keys: list[str], order: str, body: str, codes: list[tuple[int, int]], ahead: str | None = None, used: str | None = None, told: tuple[list[str], Callable[[np.ndarray, np.ndarray], list[np.ndarray]]] | None = None
) -> DataFrame:
    """``chunks`` with ``skip``, the bits at a chunk's beginning that end a code of the chunk before, and ``symbols``, of the codes that begin in it.

    ``order`` counts from 0 without gaps, and all chunks but a stream's last have at least two bytes. What a chunk leaves of
    its last code depends on where its first begins, and there are few such places: a chunk is a table from one to the
    other, tables are scanned, and then every chunk is read from its own place. Digits that the stream's end leaves of a
    code are no symbol. ``ahead`` is a column of the next chunk's first two bytes, where they are at hand; ``used`` one of
    the bits of a chunk in which codes may begin, where a stream's end is padded. ``told`` has names of numbers to return in
    place of ``symbols``, and what makes them of the symbols of many chunks and how many each has.
    """
    strings(codes)
    most, symbol, length = _lookup(codes)
    c, wide = chunks, len(keys) + 1
    if ahead is None:
        ahead, after = "_next", chunks.select(*keys, (F.col(order) - 1).alias(order), F.substring(F.col(body), 1, 2).alias("_next"))
        c = chunks.join(after, [*keys, order], "left")
    c = c.withColumn(ahead, F.coalesce(F.col(ahead), F.unhex(F.lit(""))))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [_overs(words, own, most, length).T.reshape(-1) for _, words, own, _ in _lanes(b.column(wide), b.column(wide + 1))]
            t = np.concatenate(t or [np.zeros(0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:wide], pa.ListArray.from_arrays(pa.array(np.arange(0, len(t) + 1, most, dtype=np.int32)), pa.array(t))], [*keys, order, "_t"])

    chained = lambda a, b: F.struct(F.transform(a["t"], lambda s: b["t"][s]).alias("t"))
    same = F.struct(F.sequence(F.lit(0), F.lit(most - 1)).alias("t"))
    t = c.select(*keys, order, body, ahead).mapInArrow(tables, _fields(chunks, [*keys, order], ("_t", T.ArrayType(T.IntegerType()))))
    before = states_before(t, keys, order, F.struct(F.col("_t").alias("t")), chained, same, "_before")
    before = before.select(*keys, F.col(order).cast(chunks.schema[order].dataType).alias(order), F.col("_before.t")[0].alias("skip"))
    rest = [n for n in chunks.columns if n not in (*keys, order, body, ahead, used)]
    first = [*keys, order, body, ahead, *([used] if used else []), *rest]
    back = [*keys, order, *[n for n in chunks.columns if n not in (*keys, order)]]
    names = [*back, "skip", *(told[0] if told else ["symbols"])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            skip = np.asarray(b.column("skip")).astype(np.int64)
            out, counts = [], []
            for rows, words, own, there in _lanes(b.column(wide), b.column(wide + 1)):
                until = np.minimum(own, np.asarray(b.column(used))[rows]) if used else own
                for into, x in zip((out, counts), _symbols(words, skip[rows], until, there, most, symbol, length), strict=True):
                    into.append(x)
            out, counts = np.concatenate(out), np.concatenate(counts)
            if told:
                found = [pa.array(x, pa.int64()) for x in told[1](out, counts)]
            else:
                found = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(out))]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in back], b.column("skip"), *found], names)

    more = [(n, T.LongType()) for n in told[0]] if told else [("symbols", T.ArrayType(T.LongType()))]
    # tables take far more room than their files tell, so they are not sent to every task
    return c.select(*first).join(before.hint("merge"), [*keys, order]).select(*first, "skip").mapInArrow(read, _fields(chunks, back, ("skip", T.IntegerType()), *more))


def strict_end(stream: Column, used_bits: Column) -> Column:
    """Whether a stream ends where its codes do: ``ok``, ``truncated``, ``trailing bytes`` or ``non-zero padding``."""
    size = F.octet_length(stream)
    last = F.conv(F.hex(F.substring(stream, size, F.lit(1))), 16, 10).cast("bigint")
    rest = F.floor(last / F.pow(F.lit(2.0), (used_bits % 8).cast("int")))
    need = F.floor((used_bits + 7) / 8)
    return F.when(need > size, "truncated").when(need < size, "trailing bytes").when((used_bits % 8 != 0) & (rest != 0), "non-zero padding").otherwise("ok")
