"""Pictures of two-by-two blocks rendered in tiles, each with the blocks around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, lanes in the order green, blue, red: luma steps of textured blocks, what rounds a blend at each of a block's four pixels, and the widths that are packed.
STEPS = [(8, 4, 8), (16, 8, 16), (40, 20, 40), (80, 40, 80)]
ROUND = {"green": (0, 12, 8, 4), "blue": (0, 12, 8, 4), "red": (24, 0, 8, 16)}
LARGEST = (255, 127, 255)
FIELDS = ["green", "blue", "red", "step", "signs"]


def tiles(blocks: DataFrame, key: str, tile: int) -> DataFrame:
    """(key, ty, tx, cells): blocks by tiles of ``tile`` blocks a side, those next to a tile's sides among its cells, ``at`` telling their place."""
    side = tile + 2
    ty, tx = F.floor(F.col("by") / tile), F.floor(F.col("bx") / tile)

    def cell(dy: int, dx: int):
        y, x = F.col("by") - (ty + dy) * tile + 1, F.col("bx") - (tx + dx) * tile + 1
        # the sides count, the corners do not
        near = y.between(0, side - 1) & x.between(0, side - 1) & (y.between(1, tile) | x.between(1, tile))
        return F.when(near, F.struct((ty + dy).alias("ty"), (tx + dx).alias("tx"), (y * side + x).cast("int").alias("at"), *[F.col(f).cast("int").alias(f) for f in FIELDS], F.col("textured").alias("textured")))

    around = F.array_compact(F.array(*[cell(dy, dx) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]))
    c = blocks.select(F.col(key).alias("_k"), F.explode(around).alias("c"))
    own = F.exists("cells", lambda x: (F.floor(x["at"] / side).between(1, tile)) & (x["at"] % side).between(1, tile))
    return c.groupBy("_k", "c.ty", "c.tx").agg(F.collect_list("c").alias("cells")).where(own).withColumnRenamed("_k", key)


def _rendered(cells: dict[str, np.ndarray], top: int, left: int, wide: int, high: int, tile: int) -> np.ndarray:
    """The pixels of one tile whose first pixel is (left, top) in a picture of wide x high pixels."""
    side = tile + 2
    lanes = np.zeros((side, side, 3), np.int64)
    textured, there = np.zeros((side, side), bool), np.zeros((side, side), bool)
    step, signs = np.zeros((side, side), np.int64), np.zeros((side, side), np.int64)
    y, x = np.divmod(cells["at"], side)
    for k, lane in enumerate(FIELDS[:3]):
        lanes[y, x, k] = cells[lane]
    textured[y, x], there[y, x], step[y, x], signs[y, x] = cells["textured"], True, cells["step"], cells["signs"]
    h, w = min(2 * tile, high - top), min(2 * tile, wide - left)
    py, px = np.mgrid[0:h, 0:w]
    by, bx, odd_y, odd_x = py // 2 + 1, px // 2 + 1, py % 2, px % 2
    phase = odd_y * 2 + odd_x
    own = lanes[by, bx]
    beside = lambda ny, nx: np.where((textured[ny, nx] | ~there[ny, nx])[..., None], own, lanes[ny, nx])
    row_edge, column_edge = (top + py == 0) | (top + py == high - 1), (left + px == 0) | (left + px == wide - 1)
    across, along = beside(by, bx + 2 * odd_x - 1), beside(by + 2 * odd_y - 1, bx)
    total = 2 * own + np.where(row_edge[..., None], own, across) + np.where(row_edge[..., None], own, along)
    rounding = np.stack([np.array(ROUND[n])[phase] for n in FIELDS[:3]], axis=-1)
    blend = (total + rounding) >> np.array([4, 4, 5]) & np.array([63, 31, 31])
    sign = signs[by, bx] >> 2 * phase
    moved = own + np.where(sign & 1, 1, np.where(sign & 2, -1, 0))[..., None] * np.array(STEPS)[step[by, bx]]
    plain = np.where((column_edge & ~row_edge)[..., None], own, np.clip(moved, 0, LARGEST)) >> np.array([2, 2, 3])
    flat = ~(column_edge & ~row_edge) & ~textured[by, bx]
    green, blue, red = np.moveaxis(np.where(flat[..., None], blend, plain), -1, 0)
    return red << 11 | green << 5 | blue


def blended(blocks: DataFrame, key: str, wide: int, high: int, tile: int = 16) -> DataFrame:
    """Rows of 16-bit pixels of the pictures that ``blocks`` make: key, y, x (of the first pixel), pixels.

    ``blocks`` has key, bx, by, the lanes green, blue and red, textured, step (0 to 3) and signs (two bits a pixel: 1 up, 2
    down). A flat block's pixels are a blend with the neighbours on the pixel's own sides, which count as the block itself
    where they are textured; textured blocks are sharp; rows at the top and bottom blend with nothing, and columns at the
    sides are plain. A picture may be of any size: a task renders tiles, with the blocks next to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, k = b.column("cells"), b.column(key)
            for r, (ty, tx) in enumerate(zip(b.column("ty").to_pylist(), b.column("tx").to_pylist(), strict=True)):
                own = cells[r].values
                fields = {n: own.field(n).to_numpy(zero_copy_only=False) for n in ["at", "textured", *FIELDS]}
                top, left = 2 * tile * ty, 2 * tile * tx
                out = _rendered(fields, top, left, wide, high, tile)
                n = len(out)
                yield pa.RecordBatch.from_arrays([k.take(pa.array([r] * n)), pa.array(range(top, top + n), pa.int64()), pa.array([left] * n, pa.int64()), pa.array(out.tolist(), pa.list_(pa.int64()))], [key, "y", "x", "pixels"])

    kind = blocks.schema[key].dataType.simpleString()
    return tiles(blocks, key, tile).mapInArrow(run, f"{key} {kind}, y bigint, x bigint, pixels array<bigint>")
