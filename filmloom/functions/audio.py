"""Sample formats as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def alaw_to_s16(code: Column) -> Column:
    """A-law (G.711) expansion of a byte 0..255."""
    a = code.bitwiseXOR(F.lit(0x55))
    seg, base = F.shiftright(a.bitwiseAND(F.lit(0x70)), 4), F.shiftleft(a.bitwiseAND(F.lit(0x0F)), 4)
    t = F.when(seg == 0, base + 8).otherwise((base + 0x108) * F.pow(F.lit(2), F.greatest(seg - 1, F.lit(0))).cast("bigint"))
    return F.when(a.bitwiseAND(F.lit(0x80)) != 0, t).otherwise(-t)


def s8_of_s16(sample: Column) -> Column:
    """The high byte, signed."""
    return F.shiftright(sample, 8)


def s16_of_s8(sample: Column) -> Column:
    return F.shiftleft(sample, 8)


def e8_to_s16(code: Column) -> Column:
    """Exponential byte to a sample: 8 segments of 16 steps that double, the sign in the lowest bit."""
    m = F.shiftright(code, 1)
    size = 8 * (16 + m % 16) * F.pow(F.lit(2), F.shiftright(m, 4)).cast("bigint") - 128
    return F.when(code % 2 == 1, -size).otherwise(size).cast("bigint")


def e8_of_s16(sample: Column) -> Column:
    """The code of the nearest magnitude of the sample's sign, the lower of two equally near; saturates.

    The segment is the bit length of the magnitude plus 128, so no table is searched.
    """
    size = F.least(F.abs(sample), F.lit(31616))
    seg = F.length(F.bin(size + 128)) - 8
    step = F.pow(F.lit(2), seg + 3).cast("bigint")
    m = (seg * 16 + F.floor((size + 128) / step) - 16).cast("bigint")
    low, high = e8_to_s16(2 * m), e8_to_s16(2 * m + 2)
    m = F.when((m < 127) & (high - size < size - low), m + 1).otherwise(m)
    return (2 * m + F.when(sample < 0, 1).otherwise(0)).cast("bigint")


# Step sizes and index moves of IMA ADPCM, and the two steps in which the other variant differs.
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2747, 3022, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
IMA_MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]
ESCAPE_STEPS = {62: 2749, 63: 3024}


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _moved(index: Column, code: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(88), index + _ints(IMA_MOVES)[(code % 8).cast("int")])).cast("bigint")


def _s16(v: Column) -> Column:
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), v)).cast("bigint")


def _bit(code: Column, bit: int) -> Column:
    return code.bitwiseAND(F.lit(bit).cast("bigint")) != 0


def adpcm_state(predicted: Column, index: Column, samples: Column | None = None) -> Column:
    """State of a fold: predicted sample, step index and, of a decoder, the samples so far."""
    return F.struct(predicted.cast("bigint").alias("p"), index.cast("bigint").alias("i"), (F.array().cast("array<bigint>") if samples is None else samples).alias("out"))


#: Values folded into one array; arrays of these are put together afterwards, so nothing grows value by value beyond it.
BLOCK = 256


def _folded(values: Column, start: Column, one: Callable[[Column, Column], Column]) -> Column:
    """The fold of an array from a start state; longer ones a block at a time with the state carried over."""

    def block(s: Column, own: Column) -> Column:
        inner = F.aggregate(own, adpcm_state(s["p"], s["i"]), one)
        return F.transform(F.array(inner), lambda r: F.struct(r["p"].alias("p"), r["i"].alias("i"), F.concat(s["out"], F.array(r["out"])).alias("out")))[0]

    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(values) - 1), F.lit(BLOCK))
    zero = F.struct(start["p"].alias("p"), start["i"].alias("i"), F.array().cast("array<array<bigint>>").alias("out"))
    done = F.transform(F.array(values), lambda v: F.aggregate(F.transform(cuts, lambda at: F.slice(v, at + 1, BLOCK)), zero, block))[0]
    long = F.transform(F.array(done), lambda s: adpcm_state(s["p"], s["i"], F.concat(start["out"], F.flatten(s["out"]))))[0]
    return F.when(F.size(values) <= BLOCK, F.aggregate(values, start, one)).otherwise(long)


def _ima_size(step: Column, c: Column) -> Column:
    """How far a code moves the sample: the bits of the code weigh the step, its half and its quarter, and an eighth always counts."""
    return F.shiftright(step, 3) + F.when(_bit(c, 4), step).otherwise(0) + F.when(_bit(c, 2), F.shiftright(step, 1)).otherwise(0) + F.when(_bit(c, 1), F.shiftright(step, 2)).otherwise(0)


def _escape_size(step: Column, c: Column) -> Column:
    """The same without the eighth, rounded once."""
    return F.shiftright(c % 8 * step, 2)


#: Steps and move of each variant.
VARIANTS = {"ima": (IMA_STEPS, _ima_size), "escape": ([ESCAPE_STEPS.get(i, v) for i, v in enumerate(IMA_STEPS)], _escape_size)}


def _moved_by(variant: str, index: Column, c: Column) -> Column:
    steps, size = VARIANTS[variant]
    d = size(_ints(steps)[index.cast("int")], c)
    return F.when(_bit(c, 8), -d).otherwise(d).cast("bigint")


def adpcm_decode(codes: Column, start: Column, variant: str) -> Column:
    """Fold of an array of four-bit codes from a start state; ``out`` gets the samples."""

    def one(s: Column, c: Column) -> Column:
        p = _s16(s["p"] + _moved_by(variant, s["i"], c))
        return adpcm_state(p, _moved(s["i"], c), F.concat(s["out"], F.array(p)))

    return _folded(codes, start, one)


def ima_decode(codes: Column, start: Column) -> Column:
    return adpcm_decode(codes, start, "ima")


def ima_encode(samples: Column, start: Column) -> Column:
    """Fold of an array of samples from a start state; ``out`` gets the four-bit codes."""

    def one(s: Column, x: Column) -> Column:
        step = _ints(IMA_STEPS)[s["i"].cast("int")]
        off = F.abs(x - s["p"])
        # three halvings of the step; what is below the last is lost
        c4 = F.when(off >= step, 4).otherwise(0)
        rest = off - F.when(c4 > 0, step).otherwise(0)
        c2 = F.when(rest >= F.shiftright(step, 1), 2).otherwise(0)
        rest = rest - F.when(c2 > 0, F.shiftright(step, 1)).otherwise(0)
        c1 = F.when(rest >= F.shiftright(step, 2), 1).otherwise(0)
        d = F.shiftright(step, 3) + F.when(c4 > 0, step).otherwise(0) + F.when(c2 > 0, F.shiftright(step, 1)).otherwise(0) + F.when(c1 > 0, F.shiftright(step, 2)).otherwise(0)
        code = (F.when(x < s["p"], 8).otherwise(0) + c4 + c2 + c1).cast("bigint")
        return adpcm_state(_s16(s["p"] + F.when(x < s["p"], -d).otherwise(d)), _moved(s["i"], code), F.concat(s["out"], F.array(code)))

    return _folded(samples, start, one)


def escape_decode(codes: Column, start: Column) -> Column:
    """As ``ima_decode`` for the variant without the eighth of a step and with two other steps."""
    return adpcm_decode(codes, start, "escape")


def clamp_map(add: Column, low: Column, high: Column) -> Column:
    """The map of x to x + add, held between low and high. Maps of this form compose to one of this form."""
    return F.struct(add.cast("bigint").alias("d"), low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi"))


def clamped(m: Column, x: Column) -> Column:
    return F.least(m["hi"], F.greatest(m["lo"], x + m["d"]))


def clamp_then(first: Column, second: Column) -> Column:
    return clamp_map(first["d"] + second["d"], clamped(second, first["lo"]), clamped(second, first["hi"]))


#: A map that changes no state; bounds far beyond any sum of moves.
SAME = (0, -(1 << 60), 1 << 60)


def same() -> Column:
    return clamp_map(*map(F.lit, SAME))


def index_map(codes: Column) -> Column:
    """What an array of codes makes of the step index before it."""
    return F.aggregate(codes, same(), lambda m, c: clamp_then(m, clamp_map(_ints(IMA_MOVES)[(c % 8).cast("int")], F.lit(0), F.lit(88))))


def sample_map(codes: Column, index: Column, variant: str) -> Column:
    """What an array of codes makes of the sample before it, if the step index before it is ``index``."""
    start = F.struct(index.cast("bigint").alias("i"), same().alias("m"))

    def one(s: Column, c: Column) -> Column:
        own = clamp_map(_moved_by(variant, s["i"], c), F.lit(-32768), F.lit(32767))
        return F.struct(_moved(s["i"], c).alias("i"), clamp_then(s["m"], own).alias("m"))

    return F.aggregate(codes, start, one, lambda s: s["m"])


def nibbles(payload: Column, high_first: bool) -> Column:
    """Four-bit codes of a binary column, each cut from its own byte."""
    half = lambda i: i % 2 + 1 if high_first else 2 - i % 2
    one = lambda i: F.conv(F.substring(F.hex(F.substring(payload, F.shiftright(i, 1) + 1, F.lit(1))), half(i), F.lit(1)), 16, 10).cast("bigint")
    return F.when(F.octet_length(payload) > 0, F.transform(F.sequence(F.lit(0), 2 * F.octet_length(payload) - 1), one)).otherwise(F.array().cast("array<bigint>"))


def sound_decoder(codec: Column, precision: Column, label: Column, name: Column, video: Column | None = None) -> Column:
    """The decoder of a track from a movie's header; null where there is no track, ``unknown`` where none fits.

    ``video`` is the movie's video codec: codec 500 brings sound of its own, whatever the track says.
    """
    has = lambda c, t: F.contains(F.lower(c), F.lit(t))
    linear = F.when(has(label, "unsign"), "unsigned-8").otherwise("signed-8")
    eight = F.when(has(label, "alaw") | has(label, "a-law"), "alaw").when(has(label, "lin"), linear).otherwise("ulaw")
    first = F.when((precision == 4) | has(label, "adpcm"), "adpcm").when(precision == 16, "signed-16").when(precision == 8, eight).otherwise("unknown")
    escape = F.when(precision == 4, "escape-adpcm").when(precision == 8, "unsigned-8").when(precision == 16, "signed-16").otherwise("unknown")
    named = F.when(has(name, "adpcm"), "adpcm").otherwise("unknown")
    iota = F.lit(False) if video is None else video == 500
    return F.when(codec == 0, F.lit(None).cast("string")).when(iota, "iota").when(codec == 2, named).when(codec == 101, escape).when(codec == 1, first).otherwise("unknown")
