"""Coding modes of blocks: a copy, data, or a split into four smaller blocks, each a copy or data of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filmloom.operators.pictures import _accepted, _planes, _profile, legal, temporal_vectors

#: Vectors of the format into the picture itself, by block size; they point to what is coded earlier.
SPATIAL = {
    4: [(-2, -4), (-1, -4), (0, -4), (1, -4), (2, -4), (-4, 0), (-4, -1), (-4, -2)],
    2: [(-2, -2), (-1, -2), (0, -2), (1, -2), (2, -2), (-2, -1), (-2, 0), (-3, 0)],
}
#: Bits of a still copy, of a split's opcode and of data's opcode with both chroma fields.
STILL_BITS, SPLIT_BITS, DATA_BITS = 2, 2, 12
FAMILIES = ["stationary", "temporal", "spatial"]
NONE = 1 << 40


def places(side: int, block: int) -> list[tuple[int, int, int, int]]:
    """(parent, child, x, y) of the blocks of a picture in coding order: parents by rows, the four children of each by rows."""
    wide = side // 4
    out = [(y // 4 * wide + x // 4, y % 4 // 2 * 2 + x % 4 // 2, x, y) for y in range(0, side, block) for x in range(0, side, block)]
    return sorted(out)


def coded_before(x: int, y: int, dx: int, dy: int, block: int, side: int) -> bool:
    """Whether all pixels that a vector into the picture itself points to are in it and belong to blocks coded earlier."""
    if not legal(x, y, dx, dy, block, side):
        return False
    order = lambda px, py: (py // 4 * (side // 4) + px // 4, py % 4 // 2 * 2 + px % 4 // 2 if block == 2 else 0)
    return all(order(x + dx + i, y + dy + j) < order(x, y) for i in range(block) for j in range(block))


def vector_length(dx: int, dy: int, block: int) -> int:
    """Bits of a vector into the previous picture with its opcode; vectors into the picture itself are as long as those of ring three."""
    return {1: 5, 2: 6, 3: 7}.get(max(abs(dx), abs(dy)), 10) + (2 if block == 4 else 1)


def _copies(now: list[np.ndarray], before: list[np.ndarray], x: int, y: int, block: int, level: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 3) errors and bits of the best accepted copy of each family, errors NONE where none is."""
    rows = len(now[0])
    errors, bits = np.full((rows, 3), NONE), np.zeros((rows, 3), np.int64)
    cut = lambda planes, dx=0, dy=0: [p[:, y + dy : y + dy + block, x + dx : x + dx + block] for p in planes]
    mine = cut(now)
    spatial = (2 if block == 4 else 1) + 7
    moves = [(0, before, 0, 0, STILL_BITS)]
    moves += [(1, before, dx, dy, vector_length(dx, dy, block)) for dx, dy in temporal_vectors() if legal(x, y, dx, dy, block, side)]
    moves += [(2, now, dx, dy, spatial) for dx, dy in SPATIAL[block] if coded_before(x, y, dx, dy, block, side)]
    for family, planes, dx, dy, n in moves:
        p = _profile(mine, cut(planes, dx, dy))
        less = _accepted(p, block)[:, level] & (p[0] < errors[:, family])
        errors[less, family], bits[less, family] = p[0][less], n
    return errors, bits


def _choice(errors: np.ndarray, bits: np.ndarray, ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """The family taken, -1 for none, and its bits: the first accepted one, or that of least error, fewest bits of equals."""
    found = errors < NONE
    rank = np.broadcast_to(np.arange(3), errors.shape) if ordered else errors * 256 + bits * 4 + np.arange(3)
    at = np.where(found, rank, np.iinfo(np.int64).max).argmin(axis=1)
    return np.where(found.any(axis=1), at, -1), bits[np.arange(len(at)), at]


def _data(luma: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks (n, size, size): bits without the first pixel, the first pixel, and the mean carried on."""
    guess = luma.copy()
    guess[:, 0, 1:] = luma[:, 0, :-1]
    guess[:, 1:, 0] = luma[:, :-1, 0]
    guess[:, 1:, 1:] = (luma[:, 1:, :-1] + luma[:, :-1, 1:]) >> 1
    n = lengths[(luma - guess) & 63]
    n[:, 0, 0] = 0
    return DATA_BITS + n.sum(axis=(1, 2)), luma[:, 0, 0], luma.sum(axis=(1, 2)) // luma[0].size


def split_modes(pairs: DataFrame, planes: list[str], level: int, lengths: list[int], side: int = 8) -> DataFrame:
    """Per picture, policy and 4x4 block its mode, the children's modes and the bits: frame_no, policy, k, mode, children, bits.

    ``pairs`` is that of ``with_previous``, chroma signed; ``lengths`` are bits of luma residuals. A block that a loss level
    lets copy is copied, by policy ``ordered`` from the first family that may, by ``lowest`` with the least error. Others are
    data, or split if the split's opcode and its children's bits are fewer. ``children`` has a letter for each child.

    Copies from the picture itself are judged on its own pixels, so blocks do not wait for each other; only the mean that
    predicts a data block's first pixel is carried from data block to data block, through a split as well.
    """
    size = np.array(lengths, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, before = _planes(b, planes, side), _planes(b, [f"prev_{p}" for p in planes], side)
            copies = {(block, k, s): _copies(now, before, x, y, block, level, side) for block in (4, 2) for k, s, x, y in places(side, block)}
            data = {(block, k, s): _data(now[0][:, y : y + block, x : x + block], size) for block in (4, 2) for k, s, x, y in places(side, block)}
            for policy in ("ordered", "lowest"):
                carried = np.zeros(b.num_rows, np.int64)
                for k, _, _, _ in places(side, 4):
                    family, copy_bits = _choice(*copies[4, k, 0], policy == "ordered")
                    base, first, mean = data[4, k, 0]
                    data_bits = base + size[(first - carried) & 63]
                    split_bits, inner, letters = np.full(b.num_rows, SPLIT_BITS), carried, []
                    for s in range(4):
                        child, child_bits = _choice(*copies[2, k, s], policy == "ordered")
                        own, top, average = data[2, k, s]
                        split_bits = split_bits + np.where(child < 0, own + size[(top - inner) & 63], child_bits)
                        inner = np.where(child < 0, average, inner)
                        letters.append(np.array(["d", "s", "t", "p"])[child + 1])
                    split = (family < 0) & (split_bits < data_bits)
                    mode = np.where(family >= 0, np.array(["data", *FAMILIES])[family + 1], np.where(split, "split", "data"))
                    children = np.where(split, letters[0].astype(object) + letters[1] + letters[2] + letters[3], "")
                    bits = np.where(family >= 0, copy_bits, np.where(split, split_bits, data_bits))
                    carried = np.where(family >= 0, carried, np.where(split, inner, mean))
                    n = b.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [b.column("frame_no"), pa.array([policy] * n), pa.array(np.full(n, k)), pa.array(mode.tolist(), pa.string()), pa.array(children.tolist(), pa.string()), pa.array(bits)], ["frame_no", "policy", "k", "mode", "children", "bits"]
                    )

    return pairs.mapInArrow(run, "frame_no bigint, policy string, k bigint, mode string, children string, bits bigint")


def spatial_sources(pictures: DataFrame, planes: list[str], side: int = 8) -> DataFrame:
    """Copies of blocks of both sizes from the picture itself: frame_no, size, k, s, sources, ord, err.

    ``sources`` are the format's vectors that point to pixels coded before the block, ``ord`` the one of least error, first of
    equals, and ``err`` that error; both null where there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, n = _planes(b, planes, side), b.num_rows
            for block in (4, 2):
                for k, s, x, y in places(side, block):
                    best, at, sources = np.full(n, NONE), np.zeros(n, np.int64), 0
                    mine = [p[:, y : y + block, x : x + block] for p in now]
                    for order, (dx, dy) in enumerate(SPATIAL[block]):
                        if coded_before(x, y, dx, dy, block, side):
                            sources += 1
                            err = _profile(mine, [p[:, y + dy : y + dy + block, x + dx : x + dx + block] for p in now])[0]
                            less = err < best
                            best[less], at[less] = err[less], order
                    none = best == NONE
                    fixed = [pa.array(np.full(n, v)) for v in (block, k, s, sources)]
                    yield pa.RecordBatch.from_arrays([b.column("frame_no"), *fixed, pa.array(at, mask=none), pa.array(best, mask=none)], ["frame_no", "size", "k", "s", "sources", "ord", "err"])

    return pictures.mapInArrow(run, "frame_no bigint, size bigint, k bigint, s bigint, sources bigint, ord bigint, err bigint")
