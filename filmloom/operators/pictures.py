"""Operators on whole pictures: a row is a picture with one array per plane, so a join moves one row per picture."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.operators.quality import THRESHOLDS


def with_previous(pictures: DataFrame, planes: list[str]) -> DataFrame:
    """Pictures joined with the one before them: frame_no, the planes, and these of the other as ``prev_<plane>``."""
    before = pictures.select((F.col("frame_no") + 1).alias("frame_no"), *[F.col(p).alias(f"prev_{p}") for p in planes])
    return pictures.join(before, "frame_no")


def signed(c: Column, half: int = 16) -> Column:
    """Chroma of a raw field, negative from ``half`` on."""
    return F.when(c < half, c).otherwise(c - 2 * half)


def error_sums(a: Column, b: Column, where: Column | None = None) -> tuple[Column, Column]:
    """Sum of squared differences of two planes and the largest difference, of all pixels or of those places in ``where``."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    if where is not None:
        d = F.transform(where, lambda i: F.get(d, i))
    return F.aggregate(d, F.lit(0).cast("bigint"), lambda s, x: s + x * x), F.array_max(F.transform(d, F.abs))


def region(x: int, y: int, width: int, height: int, side: int) -> Column:
    """The places of a rectangle's pixels in a plane whose rows have ``side`` pixels."""
    return F.array(*[F.lit(r * side + c) for r in range(y, y + height) for c in range(x, x + width)])


def temporal_vectors(radius: int = 8) -> list[tuple[int, int]]:
    """(dx, dy) in code order: rings one, two and three, in a ring by row, then all farther ones by row; 288 at radius 8."""
    every = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if (dx, dy) != (0, 0)]
    return sorted(every, key=lambda v: (min(4, max(abs(v[0]), abs(v[1]))), v[1], v[0]))


def legal(x: int, y: int, dx: int, dy: int, block: int, side: int) -> bool:
    """Whether the block that a vector points to lies inside the picture."""
    return 0 <= x + dx <= side - block and 0 <= y + dy <= side - block


def _planes(b: pa.RecordBatch, names: list[str], side: int) -> list[np.ndarray]:
    return [b.column(n).flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side) for n in names]


def _profile(target: list[np.ndarray], source: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of blocks (n, size, size) in y, u, v: total error, largest luma error, pixels over errors 0 to 6, chroma errors of the means."""
    d = np.abs(target[0] - source[0])
    area = d.shape[1] * d.shape[2]
    chroma = [np.abs(t.sum((1, 2)) // area - s.sum((1, 2)) // area) for t, s in zip(target[1:], source[1:], strict=True)]
    total = d.sum((1, 2)) + area * sum(chroma) if chroma else d.sum((1, 2))
    over = np.stack([(d > k).sum((1, 2)) for k in range(7)], axis=1)
    return total, d.max((1, 2)), over, *(chroma or [np.zeros(len(d), np.int64)] * 2)


def _accepted(profile: tuple[np.ndarray, ...], block: int) -> np.ndarray:
    """(n, levels): which loss levels accept each copy."""
    total, most, over, u, v = profile
    out = np.empty((len(total), len(THRESHOLDS)), bool)
    for level, t in enumerate(THRESHOLDS):
        out[:, level] = (most <= t[1]) & (over[:, t[0]] <= (4 if block == 4 else 1)) & (u <= t[0]) & (v <= t[0]) & (total <= t[2 if block == 4 else 3])
    return out


def copy_profiles(pairs: DataFrame, block: int, planes: list[str], side: int = 8) -> DataFrame:
    """Per stationary block of ``block`` pixels: frame_no, bx, brow, total, most, over_0 to over_6, u_error, v_error, level.

    ``pairs`` is that of ``with_previous``, chroma signed. The error of a chroma plane is that of the blocks' means, rounded
    down, and counts for every pixel. ``level`` is the strictest loss level that accepts the copy, 29 where none does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, before = _planes(b, planes, side), _planes(b, [f"prev_{p}" for p in planes], side)
            for y in range(0, side, block):
                for x in range(0, side, block):
                    cut = lambda p: p[:, y : y + block, x : x + block]  # noqa: B023, E731
                    p = _profile([cut(q) for q in now], [cut(q) for q in before])
                    ok = _accepted(p, block)
                    level = np.where(ok.any(axis=1), ok.argmax(axis=1), len(THRESHOLDS))
                    place = [pa.array(np.full(b.num_rows, v // block, np.int64)) for v in (x, y)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("frame_no"), *place, *[pa.array(v.astype(np.int64)) for v in (p[0], p[1], *p[2].T, p[3], p[4], level)]],
                        ["frame_no", "bx", "brow", "total", "most", *[f"over_{k}" for k in range(7)], "u_error", "v_error", "level"],
                    )

    columns = ["frame_no", "bx", "brow", "total", "most", *[f"over_{k}" for k in range(7)], "u_error", "v_error", "level"]
    return pairs.mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def best_vectors(pairs: DataFrame, planes: list[str], block: int = 4, side: int = 8, vectors: list[tuple[int, int]] | None = None) -> DataFrame:
    """Per block the in-frame vector into the previous picture with the least total error, first of equals: frame_no, bx, brow, err, ord, dx, dy."""
    vectors = vectors or temporal_vectors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, before = _planes(b, planes, side), _planes(b, [f"prev_{p}" for p in planes], side)
            for y in range(0, side, block):
                for x in range(0, side, block):
                    mine = [p[:, y : y + block, x : x + block] for p in now]
                    best, at = np.full(b.num_rows, 1 << 40), np.zeros(b.num_rows, np.int64)
                    for order, (dx, dy) in enumerate(vectors):
                        if legal(x, y, dx, dy, block, side):
                            err = _profile(mine, [p[:, y + dy : y + dy + block, x + dx : x + dx + block] for p in before])[0]
                            less = err < best
                            best[less], at[less] = err[less], order
                    v = np.array(vectors)[at]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("frame_no"), *[pa.array(c.astype(np.int64)) for c in (np.full(len(at), x // block), np.full(len(at), y // block), best, at, v[:, 0], v[:, 1])]], ["frame_no", "bx", "brow", "err", "ord", "dx", "dy"]
                    )

    return pairs.mapInArrow(run, "frame_no bigint, bx bigint, brow bigint, err bigint, ord bigint, dx bigint, dy bigint")


def best_vectors_by_level(pairs: DataFrame, planes: list[str], levels: list[int], block: int = 4, side: int = 8, radius: int = 8) -> DataFrame:
    """Per block and loss level that accepts some vector the accepted one with the least total error, first of equals: with level, err, dx, dy."""
    vectors = temporal_vectors(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            now, before = _planes(b, planes, side), _planes(b, [f"prev_{p}" for p in planes], side)
            for y in range(0, side, block):
                for x in range(0, side, block):
                    mine = [p[:, y : y + block, x : x + block] for p in now]
                    best, at = np.full((b.num_rows, len(levels)), 1 << 40), np.zeros((b.num_rows, len(levels)), np.int64)
                    for order, (dx, dy) in enumerate(vectors):
                        if legal(x, y, dx, dy, block, side):
                            p = _profile(mine, [q[:, y + dy : y + dy + block, x + dx : x + dx + block] for q in before])
                            less = _accepted(p, block)[:, levels] & (p[0][:, None] < best)
                            best[less], at[less] = np.broadcast_to(p[0][:, None], best.shape)[less], order
                    row, column = np.nonzero(best < 1 << 40)
                    v = np.array(vectors)[at[row, column]]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("frame_no").take(pa.array(row)), *[pa.array(c.astype(np.int64)) for c in (np.full(len(row), x // block), np.full(len(row), y // block), np.array(levels)[column], best[row, column], v[:, 0], v[:, 1])]],
                        ["frame_no", "bx", "brow", "level", "err", "dx", "dy"],
                    )

    return pairs.mapInArrow(run, "frame_no bigint, bx bigint, brow bigint, level bigint, err bigint, dx bigint, dy bigint")
