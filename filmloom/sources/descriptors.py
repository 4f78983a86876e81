"""What is known of video codecs: a table of numbers, and text files that come with decoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codec number, name, colours of its words, whether a movie's label may change these, how it is decoded, wrapper of its frames.
CODECS = [
    (1, "Moving Lines", "RGB555", True, "module", None), (2, "16bpp uncompressed", "RGB555", True, "module", None), (3, "YYUV (10bpp)", "YUV555", False, "module", None), (4, "8bpp uncompressed", "PAL8", False, "module", None),
    (5, "4Y1UV (8bpp)", "YUV555", False, "module", None), (6, "16Y1UV (6bpp)", "YUV555", False, "module", None), (7, "Moving Blocks", "YUV555", False, "module", None), (8, "24bpp uncompressed", "RGB888", True, "module", None),
    (9, "YYUV8 (16bpp)", "YUV888", False, "module", None), (10, "4Y1UV8 (12bpp)", "YUV888", False, "module", None), (11, "16Y1UV8 (9bpp)", "YUV888", False, "module", None), (16, "4Y1UV8 (12bpp)", "YUV888", False, "module", None),
    (17, "Moving Blocks HQ", "YUV555", False, "module", None), (19, "Super Moving Blocks", "6Y5UV", False, "module", None), (20, "Moving Blocks Beta", "6Y6UV", False, "module", None), (21, "YUYV8 (16bpp)", "YUV888", False, "module", None),
    (22, "YY8UVd4 (12bpp)", "YUV888", False, "module", None), (23, "6Y6Y5U5V (11bpp)", "6Y5UV", False, "native", None), (24, "4x6Y1x5UV (8.5bpp)", "6Y5UV", False, "module", None), (25, "YYYYd4UVd4 (6bpp)", "6Y6UV", False, "module", None),
    (100, "Eidos Escape 100 (YUV555)", "YUV555", False, "native", None), (102, "Eidos Escape 102 (YUV555)", "YUV555", False, "native", None), (122, "Eidos Escape 122 (PAL8)", "PAL8", False, "native", None), (124, "Eidos Escape 124 (RGB555)", "RGB555", False, "native", None),
    (130, "Eidos Escape 2.0 (escape130)", "RGB888", False, "native", None), (500, "Complete Animator (TCA)", "PAL8", False, "native", None), (600, "CRAM8 AVI (MovieFS)", "PAL8", False, "module", "moviefs"), (601, "CRAM16 AVI (msvideo1, MovieFS, pass-through)", None, False, "CRAM", "moviefs"),
    (602, "Cinepak (CVID, MovieFS)", "RGB888", False, "module", "moviefs"), (603, "RPZA QT (MovieFS, pass-through)", None, False, "rpza", "moviefs"), (604, "SMC QT (MovieFS)", "PAL8", False, "module", "moviefs"), (605, "Ultimotion AVI (ulti, MovieFS, pass-through)", None, False, "ULTI", "moviefs"),
    (606, "RGB8 AVI (MovieFS)", "PAL8", False, "module", "moviefs"), (607, "RLE8 AVI (MovieFS)", "PAL8", False, "module", "moviefs"), (608, "RGB24 AVI (MovieFS)", "RGB888", False, "module", "moviefs"), (609, "RLE8 QT (MovieFS)", "PAL8", False, "module", "moviefs"),
    (610, "FLI/FLC (flic, MovieFS, pass-through)", None, False, "FLIC", "moviefs"), (613, "RLE4 QT (MovieFS)", "PAL8", False, "module", "moviefs"), (614, "QT RLE 16 (MovieFS)", "RGB555", False, "module", "moviefs"), (615, "QT RLE 24 (MovieFS)", "RGB888", False, "module", "moviefs"),
    (622, "DL animation (MovieFS)", "PAL8", False, "module", "moviefs"), (623, "ANM film (MovieFS)", "PAL8", False, "module", "moviefs"), (624, "RGB8 QT (MovieFS)", "PAL8", False, "module", "moviefs"), (626, "RGB24 QT (MovieFS)", "RGB888", False, "module", "moviefs"),
    (628, "Indeo 3.1 (IV31, MovieFS, pass-through)", None, False, "IV31", "moviefs"), (629, "Indeo 3.2 (IV32, MovieFS, pass-through)", None, False, "IV32", "moviefs"), (800, "LinePack", "RGB555", True, "module", None), (901, "Indeo Raw YVU9 (VideoFS, pass-through)", None, False, "YVU9", "videofs"),
    (902, "Indeo 3.2 (IV32, VideoFS, pass-through)", None, False, "IV32", "videofs"),
]
_SCHEMA = "codec bigint, name string, colour string, by_label boolean, way string, wrapper string"


def codecs(spark: SparkSession) -> DataFrame:
    """The table of known codecs: codec, name, colour, by_label, way (module, native, or the four letters under which frames are passed on), wrapper."""
    return spark.createDataFrame(CODECS, _SCHEMA)


def colour_of(line: Column) -> Column:
    """The colours that a line of an info text names, null where it names none."""
    own = F.ltrim(line)
    number = lambda g: F.regexp_extract(own, r"^(?:YUV|RGB) *(\d+)[^,]*(?:,[ ]*(\d+))?", g)
    first = number(1)
    second = F.when(number(2) == "", first).otherwise(number(2))
    kind = F.substring(own, 1, 3)
    deep = F.when(first == "8", F.concat(kind, F.lit("888"))).when(first == "5", F.concat(kind, F.lit("555"))).when(first == "6", F.when(second == "6", "6Y6UV").otherwise("6Y5UV"))
    return F.when(own.startswith("6Y5UV"), "6Y5UV").when(own.startswith("6Y6UV"), "6Y6UV").when(kind.isin("YUV", "RGB"), deep).when(own.rlike("^[0-9]"), "PAL8")


def infos(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` with info_name, info_colour, several, block_x and block_y.

    The name is the first line. Colours are those of line 7 if it names any, else of the first line that does; ``several``
    tells that this line has alternatives. Blocks are behind the semicolons of lines 4 and 5, powers of two up to 64; other
    numbers, or none, count as 1.
    """
    ls = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.regexp_extract(x, "^[^\r]*", 0))
    own = texts.withColumn("_ls", ls)
    at = lambda n: F.get("_ls", F.lit(n - 1))
    named = F.get(F.filter("_ls", lambda x: colour_of(x).isNotNull()), F.lit(0))
    own = own.withColumn("_c", F.when(colour_of(at(7)).isNotNull(), at(7)).otherwise(named))

    def block(n: int) -> Column:
        v = F.regexp_extract(at(n), r"^[^;]*; *([0-9]+)", 1).try_cast("bigint")
        return F.when(v.isin(1, 2, 4, 8, 16, 32, 64), v).otherwise(1).cast("bigint")

    return own.select(*texts.columns, F.nullif(at(1), F.lit("")).alias("info_name"), colour_of(F.col("_c")).alias("info_colour"), F.contains(F.col("_c"), F.lit(";")).alias("several"), block(4).alias("block_x"), block(5).alias("block_y"))


def described(movies: DataFrame, known: DataFrame, info: DataFrame, codec: str, label: str, skip_unsupported: bool = True) -> DataFrame:
    """``movies`` with name, colour, way, wrapper and status: ``ok``, ``info`` for codecs known from their info only, ``unsupported``.

    ``label`` is that of the movie's pixel depth: where a codec or a several-coloured info leaves it to the movie, the colours it
    names win. ``known`` and ``info`` have a row a codec, some dozens, and are broadcast by their size alone. Without
    ``skip_unsupported`` a codec that is in neither is an error.
    """
    m = movies.join(known.withColumnRenamed("codec", codec), codec, "left").join(info.select(F.col("codec").alias(codec), "info_name", "info_colour", "several"), codec, "left")
    base = F.coalesce("colour", "info_colour")
    has = lambda t: F.contains(F.upper(F.coalesce(F.col(label), F.lit(""))), F.lit(t))
    deep = F.when(base == "RGB888", "888").otherwise("555")
    refined = F.when(has("6Y5UV"), "6Y5UV").when(has("6Y6UV"), "6Y6UV").when(has("YUV"), F.concat(F.lit("YUV"), deep)).when(has("RGB"), F.concat(F.lit("RGB"), deep)).otherwise(base)
    status = F.when(F.col("way").isNotNull(), "ok").when(F.col("info_colour").isNotNull(), "info").otherwise("unsupported" if skip_unsupported else F.raise_error(F.lit("a codec that is not supported")))
    free = F.coalesce("by_label", "several", F.lit(False))
    return m.select(*movies.columns, F.coalesce("name", "info_name").alias("name"), F.when(free, refined).otherwise(base).alias("colour"), F.coalesce("way", F.when(F.col("info_colour").isNotNull(), "module")).alias("way"), "wrapper", status.alias("status"))


def quoted_fields(line: Column) -> Column:
    """A line's name=value parts as a map, the last of equal names; values may be quoted, by either quote, and then hold blanks."""
    parts = F.regexp_extract_all(line, F.lit("""(?:[^\\s"']|"[^"]*"|'[^']*')+"""), F.lit(0))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, """"([^"]*)"|'([^']*)'""", "$1$2"))
    pair = F.transform(F.filter(bare, lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.regexp_extract(p, "(?s)^([^=]*)=", 1).alias("k"), F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1).alias("v")))
    last = F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, i + 2, F.greatest(F.lit(1), F.size(pair))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest of fixtures: tab-separated, # before remarks, - for no previous frame."""
    own = spark.read.csv(path, sep="\t", comment="#", schema="name string, width bigint, height bigint, payload string, previous string, expected string, provenance string")
    return own.where("name <> ''").withColumn("previous", F.nullif("previous", F.lit("-"))).withColumn("key_frame", F.col("previous").isNull())
