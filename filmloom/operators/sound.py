"""Sound chunks decoded many at a time: numpy over the chunks of a batch, a byte of each at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.functions.audio import IMA_MOVES, VARIANTS

#: Bytes of a piece that longer chunks are cut into, and pieces decoded at once. Sums of a piece's samples stay within 32 bits.
PIECE, LANES = 2048, 16384
LOW, HIGH = -32768, 32767


def _tables(variant: str, high_first: bool) -> tuple[np.ndarray, ...]:
    """By step index * 256 + byte: the index afterwards * 256 and what its two codes move the sample by; by byte: what they move the index by."""
    code = np.arange(16)
    s = np.array(VARIANTS[variant][0])[:, None]
    part = np.where(code & 4, s, 0) + np.where(code & 2, s >> 1, 0) + np.where(code & 1, s >> 2, 0) + (s >> 3) if variant == "ima" else code % 8 * s >> 2
    move, turn = np.where(code & 8, -part, part), np.array(IMA_MOVES)[code % 8]
    two = np.arange(256) >> 4, np.arange(256) & 15
    first, second = two if high_first else two[::-1]
    index = np.clip(np.arange(89)[:, None] + turn[first], 0, 88)
    after = np.clip(index + turn[second], 0, 88) * 256
    flat = lambda a, kind: np.ascontiguousarray(a, kind).reshape(-1)
    return flat(after, np.int64), flat(move[:, first], np.int32), flat(move[index, second], np.int32), flat(turn[first] + turn[second], np.int64)


def _by_place(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of pieces at each place; ``size`` falls, so those that are left are the first ones."""
    left = np.searchsorted(-size, -np.arange(size[0]), "left")  # pieces with more bytes than the place
    for j, m in enumerate(left.tolist()):
        yield data[at[:m] + j]


def _index_maps(data: np.ndarray, at: np.ndarray, size: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """What each piece makes of the step index before it, as a sum held between a lowest and a highest."""
    after, _, _, turn = tables
    add, low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), 88 * 256)
    for b in _by_place(data, at, size):
        m = len(b)
        add[:m] += turn[b]
        low[:m] = after[low[:m] + b]
        high[:m] = after[high[:m] + b]
    return add, low >> 8, high >> 8


def _sample_maps(data: np.ndarray, at: np.ndarray, size: np.ndarray, tables: tuple[np.ndarray, ...], index: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same of the sample before it, from the step index before it."""
    after, first, second, _ = tables
    i, add = index * 256, np.zeros(len(at), np.int64)
    low, high = np.full(len(at), -(1 << 30), np.int32), np.full(len(at), 1 << 30, np.int32)
    for b in _by_place(data, at, size):
        m = len(b)
        k = i[:m] + b
        i[:m] = after[k]
        for d in (first[k], second[k]):
            add[:m] += d
            for bound in (low[:m], high[:m]):
                bound += d
                np.clip(bound, LOW, HIGH, out=bound)
    return add, low, high


def _sums(data: np.ndarray, at: np.ndarray, size: np.ndarray, tables: tuple[np.ndarray, ...], index: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each piece's sum of samples, largest sample, last sample and last step index."""
    after, first, second, _ = tables
    i, p = index * 256, sample.astype(np.int32)
    total, most = np.zeros(len(at), np.int32), np.full(len(at), LOW, np.int32)
    for b in _by_place(data, at, size):
        m = len(b)
        k, own = i[:m] + b, p[:m]
        np.take(after, k, out=i[:m], mode="clip")
        for d in (first, second):
            own += d[k]
            np.maximum(own, LOW, out=own)
            np.minimum(own, HIGH, out=own)
            total[:m] += own
            np.maximum(most[:m], own, out=most[:m])
    return total, most, p, i >> 8


def _laned(f, data: np.ndarray, at: np.ndarray, size: np.ndarray, tables: tuple[np.ndarray, ...], *states: np.ndarray) -> list[np.ndarray]:
    """``f`` over all pieces, the longest first and ``LANES`` at a time; its results by piece."""
    order = np.argsort(-size, kind="stable")
    parts = [f(data, at[o], size[o], tables, *[s[o] for s in states]) for o in (order[k : k + LANES] for k in range(0, len(order), LANES))]
    out = []
    for column in zip(*parts, strict=True):
        out.append(np.empty(len(order), np.int64))
        out[-1][order] = np.concatenate(column)
    return out


def _before(begins: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """The state before each piece, 0 before a chunk's first."""
    out, now = [], 0
    for new, add, low, high in zip(begins.tolist(), *[m.tolist() for m in maps], strict=True):
        now = 0 if new else now
        out.append(now)
        now = min(high, max(low, now + add))
    return np.array(out, np.int64)


def sound_sums(data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """By chunk, none of them empty: samples, their sum, the largest, the last, and the last step index; each chunk starts from 0 and 0."""
    size = np.diff(offsets)
    pieces = -(-size // PIECE)
    start = np.cumsum(pieces) - pieces  # a chunk's first piece
    nth = np.arange(pieces.sum()) - np.repeat(start, pieces)
    at = np.repeat(offsets[:-1], pieces) + nth * PIECE
    own = np.minimum(PIECE, np.repeat(offsets[1:], pieces) - at)
    index, sample = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    # only what is cut needs to know what comes before
    cut = np.flatnonzero(np.repeat(pieces > 1, pieces))
    if len(cut):
        index[cut] = _before(nth[cut] == 0, _laned(_index_maps, data, at[cut], own[cut], tables))
        sample[cut] = _before(nth[cut] == 0, _laned(_sample_maps, data, at[cut], own[cut], tables, index[cut]))
    total, most, p, i = _laned(_sums, data, at, own, tables, index, sample)
    last = start + pieces - 1
    return [2 * size, np.add.reduceat(total, start), np.maximum.reduceat(most, start), p[last], i[last]]


def adpcm_sums(chunks: DataFrame, body: str, variant: str, high_first: bool) -> DataFrame:
    """``chunks`` without ``body``, with ``n`` samples, their ``total``, the largest as ``most``, the ``last``, and the final ``step``.

    A chunk starts from a state of its own, so chunks are decoded side by side; a long one is cut into pieces, which are
    maps of the state before them and so need no walk through the whole chunk. Chunks without bytes have no row.
    """
    kept = [c for c in chunks.columns if c != body]
    kinds = [f"{c.name} {c.dataType.simpleString()}" for c in chunks.select(*kept).schema]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(variant, high_first)
        for b in batches:
            if not b.num_rows:
                continue
            bodies = b.column(len(kept)).cast(pa.large_binary())
            offsets = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
            data = np.frombuffer(bodies.buffers()[2], np.uint8)
            sums = sound_sums(data, offsets, tables)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *[pa.array(s, pa.int64()) for s in sums]], [*kept, "n", "total", "most", "last", "step"])

    schema = ", ".join([*kinds, *[f"{c} bigint" for c in ("n", "total", "most", "last", "step")]])
    return chunks.where(F.octet_length(body) > 0).select(*kept, body).mapInArrow(summed, schema)
