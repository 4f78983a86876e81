"""Pixel arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb555(r: Column, g: Column, b: Column) -> Column:
    """A 15-bit word, red low, each part truncated to five bits."""
    return (F.shiftright(r, 3)).bitwiseOR(F.shiftleft(F.shiftright(g, 3), 5)).bitwiseOR(F.shiftleft(F.shiftright(b, 3), 10))


def widen5(c: Column) -> Column:
    """Five bits to eight by repeating the upper ones."""
    return F.shiftleft(c, 3).bitwiseOR(F.shiftright(c, 2))


def widen6(c: Column) -> Column:
    """Six bits to eight by repeating the upper ones."""
    return F.shiftleft(c, 2).bitwiseOR(F.shiftright(c, 4))


def signed_chroma(c: Column, half: int = 16) -> Column:
    """Chroma in modulo form to a signed number."""
    return F.when(c >= half, c - 2 * half).otherwise(c)


# 16.16 weights of the luma sum and of the partial sums behind the two colour differences.
LUMA_WEIGHTS = (19595, 38470, 7471)
U_WEIGHTS = (22117, 43419)
V_WEIGHTS = (54878, 10658)


def bayer(n: int) -> list[list[int]]:
    """The n x n ordered-dither matrix, by recursive doubling; n is a power of two."""
    if n == 1:
        return [[0]]
    m = bayer(n // 2)
    top = [[4 * v for v in row] + [4 * v + 2 for v in row] for row in m]
    return top + [[4 * v + 3 for v in row] + [4 * v + 1 for v in row] for row in m]


def luma(r: Column, g: Column, b: Column, most: int, x: Column | None = None, y: Column | None = None, dither: int = 0) -> Column:
    """Luma 0..most of 24-bit colours, rounded, or with the threshold of a dither matrix of that side at (x, y)."""
    full = r * LUMA_WEIGHTS[0] + g * LUMA_WEIGHTS[1] + b * LUMA_WEIGHTS[2]
    if dither:
        flat = F.array(*[F.lit(v << (24 - 2 * (dither.bit_length() - 1))) for row in bayer(dither) for v in row])
        step = flat[(y % dither * dither + x % dither).cast("int")]
    else:
        step = F.lit(1 << 23)
    return F.shiftright(full * most + step, 24).cast("bigint")


def chroma(r: Column, g: Column, b: Column, most: int) -> tuple[Column, Column]:
    """U and V as ``most + 1`` modular steps."""

    def steps(diff: Column) -> Column:
        scaled = F.shiftright(diff, 1) * most
        return F.shiftright(scaled + F.when(scaled >= 0, 128).otherwise(-128), 8).bitwiseAND(F.lit(most)).cast("bigint")

    return steps(b - F.shiftright(r * U_WEIGHTS[0] + g * U_WEIGHTS[1], 16)), steps(r - F.shiftright(g * V_WEIGHTS[0] + b * V_WEIGHTS[1], 16))


def nearest(v: Column, n: int) -> Column:
    """v / n, halves away from zero."""
    return F.when(v >= 0, F.floor((v + n // 2) / n)).otherwise(-F.floor((n // 2 - v) / n)).cast("bigint")


def toward_zero(v: Column, n: int) -> Column:
    return F.when(v >= 0, F.floor(v / n)).otherwise(-F.floor(-v / n)).cast("bigint")


def clamp8(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("bigint")


def preview(y: Column, u: Column, v: Column, luma_most: int, chroma_most: int) -> tuple[Column, Column, Column]:
    """24-bit colours of quantised ones, for display; every division is rounded to nearest."""
    half = (chroma_most + 1) // 2
    a = nearest(y * 255, luma_most)
    p, q = nearest(signed_chroma(u, half) * 256, chroma_most), nearest(signed_chroma(v, half) * 256, chroma_most)
    return clamp8(a + nearest(1402 * q, 1000)), clamp8(a - nearest(344 * p + 714 * q, 1000)), clamp8(a + nearest(1772 * p, 1000))


def full_range(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """24-bit colours of eight-bit luma and signed chroma; each product is cut toward zero by itself."""
    return clamp8(y + toward_zero(1402 * v, 1000)), clamp8(y - toward_zero(344 * u, 1000) - toward_zero(714 * v, 1000)), clamp8(y + toward_zero(1772 * u, 1000))


#: Fixed values, by layout: bits of luma and of each chroma in a pixel's word.
LAYOUTS = {"6Y5UV": (6, 5), "YUV555": (5, 5), "6Y6UV": (6, 6), "YUV888": (8, 8), "RGB888": (8, 8)}


def word(layout: str, y: Column, u: Column, v: Column) -> Column:
    """A pixel's word: luma in the lowest bits, then the chroma fields; null where one is out of range."""
    a, b = LAYOUTS[layout]
    fits = (y >= 0) & (y < 1 << a) & (u >= 0) & (u < 1 << b) & (v >= 0) & (v < 1 << b)
    return F.when(fits, y.bitwiseOR(F.shiftleft(u, a)).bitwiseOR(F.shiftleft(v, a + b)))


def fields(layout: str, w: Column) -> tuple[Column, Column, Column]:
    """Luma and chroma of a pixel's word."""
    a, b = LAYOUTS[layout]
    return w.bitwiseAND(F.lit((1 << a) - 1)), F.shiftright(w, a).bitwiseAND(F.lit((1 << b) - 1)), F.shiftright(w, a + b).bitwiseAND(F.lit((1 << b) - 1))


def turned_over(pixels: Column, width: int) -> Column:
    """A plane's pixels with its rows in the opposite order."""
    rows = F.sequence(F.floor(F.size(pixels) / width).cast("int") - 1, F.lit(0), F.lit(-1))
    return F.when(F.size(pixels) >= width, F.flatten(F.transform(rows, lambda r: F.slice(pixels, r * width + 1, F.lit(width))))).otherwise(pixels)
