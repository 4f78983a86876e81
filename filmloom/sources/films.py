"""Films of tagged chunks: header and palette, frames, sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions import audio, bits
from filmloom.operators.scan import adpcm_track
from filmloom.sources.scratch import kept
from filmloom.sources.walks import sized_blocks, tags, walked

#: Bytes of a film's header behind its tag, before palette entries, and before samples behind a sound's inner tag.
HEADER, PALETTE, SOUND = 40, 36, 28
#: Sound bytes decoded together.
BLOCK = 1024


def located(films: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """``films`` with ``at``, a map of tags to where the first chunk of each begins."""
    found = walked(films.select(id_col, content), content, tags, {"tag": "string", "at": "bigint", "size": "bigint", "ok": "boolean"}, "no")
    first = found.groupBy(id_col, "tag").agg(F.min("at").alias("at")).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("tag", "at"))).alias("at"))
    return films.join(first, id_col, "left")


def headers(films: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """``films`` with ``film``, the header's fields, and ``status``.

    ``frame_bytes`` are those of an unpacked frame: screen modes of 16 colours hold two pixels a byte, and some are stored at
    half their height. A mode with its lowest bit set tells its depth in bits 27 to 31. ``palette`` has red, green and blue
    of up to 256 entries and is empty without a palette.
    """
    at = lambda tag: F.col("at")[tag]
    own = located(films, id_col, content)
    word = lambda n: bits.word_at(F.col(content), at("ACEF") + 8 + n)
    size = F.octet_length(content)
    kind = F.when(word(28) % 2 == 1, F.shiftright(word(28), 27)).otherwise(F.lit(0))
    mode = F.when(kind == 3, F.lit(27)).when(kind.isin(4, 5), F.lit(28)).otherwise(word(28)).cast("bigint")
    entries = F.floor((bits.word_at(F.col(content), at("PALE") + 4) - PALETTE) / 4)
    entries = F.least(F.lit(256), F.greatest(F.lit(0), entries))
    entry = lambda k: F.struct(*[bits.word_at(F.col(content), at("PALE") + PALETTE + 4 * k + n, 1).alias(c) for n, c in ((1, "r"), (2, "g"), (3, "b"))])
    whole = (entries > 0) & (at("PALE") + PALETTE + 4 * entries <= size)
    fields = {"length": word(0), "first": word(16), "width": F.floor(word(20) / 2), "height": F.floor(word(24) / 2), "mode": mode, "technique": word(32), "update": word(36) % 2, "bits": F.when(kind == 5, 16).otherwise(8).cast("bigint")}
    palette = F.when(whole, F.transform(F.sequence(F.lit(0), entries.cast("int") - 1), entry)).otherwise(F.array().cast("array<struct<r:bigint,g:bigint,b:bigint>>"))
    h = own.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in fields.items()], palette.alias("palette")))).alias("film"))
    w, y, m = F.col("film.width"), F.col("film.height"), F.col("film.mode")
    packed, half = m.isin(27, 12, 13, 39), m.isin(12, 13, 39, 15, 36, 40)
    frame = F.when(F.col("film.bits") == 16, 2 * w * y).otherwise(F.floor(w / F.when(packed, 2).otherwise(1)) * F.floor(y / F.when(half, 2).otherwise(1)))
    odd = (F.col("film.bits") != 16) & ((packed & (w % 2 == 1)) | (half & (y % 2 == 1)))
    status = (
        F.when(at("ACEF").isNull(), "no film").when(at("ACEF") + 8 + HEADER > size, "truncated header")
        .when((F.col("film.length") < F.col("film.first")) | (at("ACEF") + 8 + F.col("film.length") > size) | (F.col("film.first") < HEADER), "bad header")
        .when(F.col("film.technique") > 2, "unknown technique").when((w == 0) | (y == 0), "no size").when(~m.isin(21, 28, 27, 12, 13, 39, 15, 36, 40), "unknown mode").when(odd, "odd size").otherwise("ok")
    )
    return h.withColumn("frame_bytes", frame.cast("bigint")).withColumn("status", status)


def frames(films: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """(id, frame_no, offset, body) of the stored frames of well-formed films; ``offset`` is the body's in the film."""
    h = headers(films, id_col, content).where("status = 'ok'")
    begin = F.col("at")["ACEF"] + 8 + F.col("film.first")
    part = h.select(id_col, begin.alias("_begin"), F.substring(F.col(content), begin.cast("int") + 1, (F.col("film.length") - F.col("film.first")).cast("int")).alias("_frames"))
    found = walked(part, "_frames", sized_blocks, {"offset": "bigint", "body": "binary"}, "frame_no")
    return found.select(id_col, "frame_no", (F.col("_begin") + F.col("offset")).alias("offset"), "body")


def sound(films: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """(id, kind, block, samples) of the films' sound; a block is BLOCK bytes of it.

    ``WAV1`` holds exponential bytes, ``WAV2`` four-bit codes, the high one first, of one track from a state of 0. Other
    kinds, and films without sound, have no rows; sound behind the film's end is left out.
    """
    own = located(films, id_col, content).withColumn("_s", F.col("at")["SOUN"] + 8)
    size = F.octet_length(content)
    own = own.where(F.col("_s") + SOUND < size).select(
        id_col, F.decode(F.substring(F.col(content), F.col("_s").cast("int") + 1, F.lit(4)), "ISO-8859-1").alias("kind"), content,
        (F.col("_s") + SOUND).alias("_at"), F.least(bits.word_at(F.col(content), F.col("_s") + 4) - SOUND, size - F.col("_s") - SOUND).alias("_n"),
    )
    own = own.where(F.col("kind").isin("WAV1", "WAV2") & (F.col("_n") > 0))
    cuts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(BLOCK).cast("bigint")), lambda k: F.substring(F.col(content), (F.col("_at") + k).cast("int") + 1, F.least(F.lit(BLOCK), F.col("_n") - k).cast("int")))
    blocks = kept(own.select(id_col, "kind", F.posexplode(cuts).alias("block", "_b")).withColumn("block", F.col("block").cast("bigint")), "sound-blocks")
    plain = blocks.where("kind = 'WAV1'").select(id_col, "kind", "block", F.transform(bits.byte_values(F.col("_b")), audio.e8_to_s16).alias("samples"))
    coded = blocks.where("kind = 'WAV2'").withColumn("_codes", audio.nibbles(F.col("_b"), True))
    return plain.union(adpcm_track(coded, [id_col], "block", "_codes", "ima").select(id_col, "kind", "block", "samples"))


def unpacked(stored: Column, width: Column, height: Column, mode: Column) -> Column:
    """The pixels of a whole screen, row by row, from an array of a frame's stored bytes.

    Modes of 16 colours have two pixels a byte, the left one low; modes that are stored at half their height show each row twice.
    """
    packed, half = mode.isin(27, 12, 13, 39), mode.isin(12, 13, 39, 15, 36, 40)

    def pixel(k: Column) -> Column:
        x, y = k % width, F.floor(k / width)
        row = F.when(half, F.floor(y / 2)).otherwise(y)
        byte = F.get(stored, F.when(packed, row * F.floor(width / 2) + F.floor(x / 2)).otherwise(row * width + x).cast("int"))
        return F.when(~packed, byte).when(x % 2 == 0, byte.bitwiseAND(F.lit(15).cast("bigint"))).otherwise(F.shiftright(byte, 4)).cast("bigint")

    return F.transform(F.sequence(F.lit(0), (width * height - 1).cast("int")), pixel)


def true_size(chunk: Column, has_palette: Column, width: Column, height: Column) -> Column:
    """(width, height) that a movie's first wrapper tells, if each is from 1 to 4096, else the header's."""
    at = F.when(has_palette, 1028).otherwise(0)
    w, h = (bits.word_at(chunk, at + n) for n in (8, 12))
    good = F.coalesce(w.between(1, 4096) & h.between(1, 4096), F.lit(False))
    return F.struct(F.when(good, w).otherwise(width).cast("bigint").alias("width"), F.when(good, h).otherwise(height).cast("bigint").alias("height"))
