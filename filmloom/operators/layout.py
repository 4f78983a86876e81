"""Container layout: prefix sums and the text catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(value: str, keys: list[str], order: list[str]) -> Column:
    """Sum of ``value`` over the rows before this one of its group. Groups must be movies or other bounded sets."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return F.coalesce(F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")


def parse_catalogue(movies: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """(id, columns ``keep``, chunk_no, file_offset, video_bytes, sound_bytes, sound_tracks, ok) of catalogues, an entry a line.

    An entry is ``offset,video[;sound[;sound...]]``. Sounds are summed; an empty sound is no track. A line of another
    form has ok false and nulls. A null or empty text has no entries.
    """
    line = movies.where(F.length(text_col) > 0).select(id_col, *(keep or []), F.posexplode(F.split(F.rtrim(F.col(text_col)), "\n")).alias("chunk_no", "line"))
    ok = F.col("line").rlike(r"^[0-9]+,[0-9]+(;[0-9]*)+$")
    tracks = F.filter(F.slice(F.split("line", ";"), 2, 1 << 20), lambda s: s != "")
    number = lambda g: F.when(F.col("ok"), F.regexp_extract("line", r"^([0-9]+),([0-9]+)", g).cast("bigint"))
    p = line.withColumn("ok", ok).withColumn("tracks", tracks)
    return p.select(
        id_col, *(keep or []), F.col("chunk_no").cast("bigint").alias("chunk_no"), number(1).alias("file_offset"), number(2).alias("video_bytes"),
        F.when(F.col("ok"), F.aggregate("tracks", F.lit(0).cast("bigint"), lambda a, s: a + s.try_cast("bigint"))).alias("sound_bytes"),
        F.when(F.col("ok"), F.size("tracks").cast("bigint")).alias("sound_tracks"), "ok",
    )


#: The largest number of a header's field: 32 bits.
MOST = (1 << 32) - 1


def parse_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` (as read by the binaryFile source) with ``head``, the fields of a movie's header, and ``status``.

    Three lines of text follow the magic; then come numbers, each with a label behind it. A blank number is 0. A sample
    rate given as a period in microseconds becomes one in Hz. A key offset that cannot be read is -1. A number of more than
    32 bits makes a header malformed.
    """
    ls = F.split(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\n")
    at = lambda n: F.coalesce(F.get(F.col("_ls"), F.lit(n - 1)), F.lit(""))
    narrow = lambda v: F.when(v <= MOST, v)
    num = lambda n: F.when(F.trim(at(n)) == "", F.lit(0).cast("bigint")).otherwise(narrow(F.regexp_extract(at(n), r"^ *(\d+)", 1).try_cast("bigint")))
    label = lambda n: F.regexp_extract(at(n), r"^ *\d* *(.*)$", 1)
    period = label(11).rlike("^(µ[sS]|Âµ[sS]|[uU][sS]( |$))")
    rate = F.when(period & (num(11) > 0), F.floor((1000000 + F.floor(num(11) / 2)) / num(11))).otherwise(num(11)).cast("bigint")
    keys = F.coalesce(F.regexp_extract(at(21), r"^ *([-+]?\d+)", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
    fields = {
        "title": at(2), "copyright": at(3), "author": at(4), "video_codec": num(5), "video_label": label(5), "width": num(6), "height": num(7), "pixel_depth": num(8), "pixel_label": label(8),
        "frames_per_second": F.regexp_extract(at(9), r"^ *([0-9.eE+-]+)", 1).try_cast("double"), "sound_codec": num(10), "sound_label": label(10), "sound_rate": rate, "sound_channels": num(12),
        "channels_label": label(12), "sound_precision": num(13), "precision_label": label(13), "frames_per_chunk": num(14), "last_chunk": num(15), "even_bytes": num(16), "odd_bytes": num(17),
        "catalogue_offset": num(18), "sprite_offset": num(19), "sprite_bytes": num(20), "key_offset": keys,
    }
    # generators of one row keep the lines and fields from being computed again wherever they are used
    h = files.select("*", F.explode(F.array(ls)).alias("_ls")).select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))).alias("head"))
    size = F.octet_length(content)
    unread = F.array_contains(F.array(*[F.col(f"head.{n}").isNull() for n in fields]), True)
    flat = (F.col("head.video_codec") != 0) & ((F.col("head.width") == 0) | (F.col("head.height") == 0))
    outside = (F.col("head.catalogue_offset") > size) | (F.col("head.sprite_offset") + F.col("head.sprite_bytes") > size) | (F.col("head.key_offset") > size)
    few = F.col("head.last_chunk") + 1 > F.floor((size - F.col("head.catalogue_offset")) / 6)
    bad = (at(1) != "ARMovie") | unread | flat | (F.col("head.frames_per_chunk") == 0) | ~(F.col("head.frames_per_second") > 0) | (F.col("head.key_offset") < -1)
    return h.withColumn("status", F.when(bad, "malformed").when(outside | few, "truncated").otherwise("ok")).drop("_ls")


#: Bytes that a catalogue's line has at most.
LINE = 1024


def read_movies(files: DataFrame, content: str = "content", id_col: str = "path") -> DataFrame:
    """Chunks of the well-formed movies among ``files``: the catalogue's entries and whether each lies inside its file.

    Only the bytes that the header's number of lines can take are looked at behind the catalogue's offset.
    """
    h = parse_headers(files, content).where("status = 'ok'")
    lines = F.col("head.last_chunk") + 1
    text = F.decode(F.substring(F.col(content), F.col("head.catalogue_offset").cast("int") + 1, F.least(F.lit(1 << 30), lines * LINE).cast("int")), "ISO-8859-1")
    cat = h.select(id_col, F.octet_length(content).alias("_size"), F.array_join(F.slice(F.split(text, "\n"), F.lit(1), lines.cast("int")), "\n").alias("_catalogue"))
    inside = F.col("ok") & (F.col("file_offset") + F.col("video_bytes") + F.col("sound_bytes") <= F.col("_size"))
    return parse_catalogue(cat, id_col, "_catalogue", ["_size"]).withColumn("ok", F.coalesce(inside, F.lit(False))).drop("_size")


#: Bytes of a sector, and of the room for a catalogue's line.
SECTOR, ENTRY = 2048, 64


def render_header(fields: dict[str, Column]) -> Column:
    """The 21 lines of a movie's header as a string; fields are those of ``parse_headers``, without labels; absent ones are 0 or empty.

    A movie without picture format has no picture size; a negative key offset stands for no keys.
    """
    get = lambda n: F.coalesce(fields.get(n, F.lit(None)).cast("string"), F.lit("0"))
    text = lambda n: F.coalesce(fields.get(n, F.lit(None)).cast("string"), F.lit(""))
    side = lambda n: F.when(get("video_codec") == "0", F.lit("0")).otherwise(get(n))
    keys = F.coalesce(fields.get("key_offset", F.lit(None)).cast("bigint"), F.lit(-1).cast("bigint"))
    lines = [
        F.lit("ARMovie"), text("title"), text("copyright"), text("author"), F.concat(get("video_codec"), F.lit(" video format")), F.concat(side("width"), F.lit(" pixels")),
        F.concat(side("height"), F.lit(" pixels")), F.concat(get("pixel_depth"), F.lit(" bits per pixel")), F.concat(get("frames_per_second"), F.lit(" frames per second")),
        F.concat(get("sound_codec"), F.lit(" sound format")), F.concat(get("sound_rate"), F.lit(" Hz samples")), F.concat(get("sound_channels"), F.lit(" channels")),
        F.concat(get("sound_precision"), F.lit(" bits per sample")), F.concat(get("frames_per_chunk"), F.lit(" frames per chunk")), F.concat(get("last_chunk"), F.lit(" number of chunks")),
        F.concat(get("even_bytes"), F.lit(" even chunk size")), F.concat(get("odd_bytes"), F.lit(" odd chunk size")), F.concat(get("catalogue_offset"), F.lit(" catalogue offset")),
        F.concat(get("sprite_offset"), F.lit(" offset to sprite")), F.concat(get("sprite_bytes"), F.lit(" size of sprite")),
        F.when(keys >= 0, F.concat(keys.cast("string"), F.lit(" offset to keys"))).otherwise(F.lit("-1 (no keys)")),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def assemble_movies(chunks: DataFrame, id_col: str, order: str, payload: str, fields: dict[str, Column]) -> DataFrame:
    """(id, content): a movie file of each id, its chunks in order, each on a sector of its own behind header and catalogue.

    The catalogue gets room for the longest possible line of every chunk, so offsets follow from sizes alone and need no
    iteration. A movie is one file and is put together in one row; rows of different movies are independent. A movie of
    more than 2 GB, which no row can hold, raises an error.
    """
    zeros = lambda n: F.encode(F.repeat(F.lit("\0"), n.cast("int")), "ISO-8859-1")
    up = lambda n: F.ceil(n / SECTOR) * SECTOR
    all_of = Window.partitionBy(id_col)
    c = chunks.select(id_col, F.col(order).alias("_o"), F.coalesce(F.col(payload), F.encode(F.lit(""), "UTF-8")).alias("_p")).withColumn("_n", F.octet_length("_p").cast("bigint"))
    c = c.withColumn("_room", up(F.count("*").over(all_of) * ENTRY)).withColumn("_sector", up(F.col("_n")).cast("bigint"))
    c = c.withColumn("_off", SECTOR + F.col("_room") + before("_sector", [id_col], ["_o"])).withColumn("_even", (F.row_number().over(all_of.orderBy("_o")) - 1) % 2 == 0)
    c = c.withColumn("_line", F.concat(F.col("_off").cast("bigint").cast("string"), F.lit(","), F.col("_n").cast("string"), F.lit(";0\n"))).withColumn("_body", F.concat("_p", zeros(F.col("_sector") - F.col("_n"))))
    largest = lambda even: F.coalesce(F.max(F.when((F.col("_even") == even) & (F.col("_n") > 0), F.col("_n") + 1)), F.lit(0))
    m = c.groupBy(id_col).agg(
        F.expr("listagg(_line, '') WITHIN GROUP (ORDER BY _o)").alias("_catalogue"), F.expr("listagg(_body, X'') WITHIN GROUP (ORDER BY _o)").alias("_data"),
        (F.count("*") - 1).alias("_last"), F.max("_off").alias("_end"), F.max("_room").alias("_room"), largest(True).alias("_e"), largest(False).alias("_d"),
    )
    own = {"last_chunk": F.col("_last"), "even_bytes": F.col("_e"), "odd_bytes": F.col("_d"), "catalogue_offset": F.lit(SECTOR)}
    head = F.encode(render_header(fields | own), "ISO-8859-1")
    catalogue = F.encode("_catalogue", "ISO-8859-1")
    m = m.withColumn("_h", head).withColumn("_c", catalogue)
    m = m.where(F.when(F.col("_end") < 1 << 31, F.lit(True)).otherwise(F.raise_error(F.lit("a movie of more than 2 GB")).cast("boolean")))
    return m.select(id_col, F.concat("_h", zeros(SECTOR - F.octet_length("_h")), "_c", zeros(F.col("_room") - F.octet_length("_c")), F.col("_data")).alias("content"))
