"""Integers and bytes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def align_up(v: Column, size: int) -> Column:
    return (v + (size - 1)).bitwiseAND(F.lit(~(size - 1)).cast("bigint"))


def varint_hex(v: Column) -> Column:
    """Seven-bit groups, the highest first, the top bit set on all but the last; as upper-case hex."""
    groups = F.when(v == 0, F.lit(1)).otherwise(F.floor(F.length(F.bin(v)) / F.lit(7.0) - F.lit(1e-9)) + 1).cast("int")
    part = lambda i: F.floor(v / F.pow(F.lit(128.0), i)).cast("bigint") % 128 + F.when(i > 0, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(groups - 1, F.lit(0), F.lit(-1)), lambda i: F.lpad(F.hex(part(i)), 2, "0")), "")


def signed_to_unsigned(v: Column) -> Column:
    """v > 0 to 2v - 1, others to -2v."""
    return F.when(v > 0, 2 * v - 1).otherwise(-2 * v)


# byte 0 is its own mirror image, and translate would delete it
_REVERSED = "".join(chr(int(f"{v:08b}"[::-1], 2)) for v in range(1, 256))


def crc32_msb(payload: Column) -> Column:
    """CRC-32 with the highest bit first, started at 0 and not inverted, of a binary column.

    Spark's own crc32 is the mirrored form with inverted start and end. Mirroring every byte, cancelling the start and
    end by those of as many zero bytes, and mirroring the result gives this one without a loop over bytes.
    """
    every = "".join(map(chr, range(1, 256)))
    mirrored = F.encode(F.translate(F.decode(payload, "ISO-8859-1"), every, _REVERSED), "ISO-8859-1")
    zeros = F.encode(F.repeat(F.lit("\0"), F.octet_length(payload)), "ISO-8859-1")
    both = F.crc32(mirrored).bitwiseXOR(F.crc32(zeros))
    return F.conv(F.reverse(F.lpad(F.bin(both), 32, "0")), 2, 10).cast("bigint")


def bytes_of_bits(bits: Column, n: int) -> Column:
    """A string of 8 n binary digits, the last bit written first, as upper-case hex of bytes written lowest first."""
    return F.concat(*[F.lpad(F.conv(F.substring(bits, 8 * (n - 1 - i) + 1, 8), 2, 16), 2, "0") for i in range(n)])


def little_endian(n: Column, size: int) -> Column:
    """A number's lowest ``size`` bytes as binary, the lowest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n.cast("bigint"), 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(size)])


def byte_values(payload: Column) -> Column:
    """The bytes of a binary column as numbers."""
    one = lambda i: F.conv(F.hex(F.substring(payload, i, F.lit(1))), 16, 10).cast("bigint")
    return F.when(F.octet_length(payload) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(payload)), one)).otherwise(F.array().cast("array<bigint>"))


def word_at(payload: Column, at: Column | int, size: int = 4) -> Column:
    """The number whose bytes, the lowest first, begin at offset ``at`` of a binary column; null beyond its end."""
    own = F.hex(F.substring(payload, (F.lit(at) if isinstance(at, int) else at).cast("int") + 1, F.lit(size)))
    return F.when(F.length(own) == 2 * size, F.conv(F.concat(*[F.substring(own, 2 * k + 1, 2) for k in range(size - 1, -1, -1)]), 16, 10).cast("bigint"))


def wav_header(data_bytes: Column, rate: int, channels: int) -> Column:
    """The 44 bytes before sixteen-bit samples in a sound file."""
    text = lambda t: F.encode(F.lit(t), "US-ASCII")
    word = lambda n, size: little_endian(F.lit(n), size)
    return F.concat(
        text("RIFF"), little_endian(data_bytes + 36, 4), text("WAVEfmt "), word(16, 4), word(1, 2), word(channels, 2), word(rate, 4), word(rate * channels * 2, 4), word(channels * 2, 2), word(16, 2), text("data"), little_endian(data_bytes, 4)
    )
