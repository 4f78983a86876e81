"""Movie and sound files written as streams of rows: header, catalogue, and chunks of frames and sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.functions import bits
from filmloom.operators.layout import SECTOR, render_header
from filmloom.operators.scan import prefix_scan
from filmloom.sources.files import wav_rows, write_files
from filmloom.sources.scratch import kept

#: Bytes first allowed for a catalogue's line, and sectors added at most until the catalogue fits.
LINE, MORE = 30, 4


def chunk_of(frame: Column, p: Column, q: Column) -> Column:
    """The chunk of a frame where chunk i ends before frame floor((i + 1) p / q); p is at least q."""
    return F.floor(((frame + 1) * q - 1) / p).cast("bigint")


def _zeros(n: Column) -> Column:
    return F.encode(F.repeat(F.lit("\0"), F.greatest(F.lit(0), n).cast("int")), "ISO-8859-1")


def chunk_table(frames: DataFrame, movies: DataFrame, fps: tuple[int, int], rate: int, sample_bytes: int) -> DataFrame:
    """(movie, chunk, first, frames, video, s0, s1, sound, file_offset, first_data, catalogue_offset, ...) of all chunks.

    ``frames`` has movie, frame_no from 0 and size; ``movies`` has movie, p and q, the frames of a chunk as a fraction of at
    least 1, and ``fields`` of the header. A movie with sound gets two chunks at least, as players need; its header then
    tells the most frames that a chunk has. A chunk's sound is that of its frames' time, to the nearest sample.
    """
    count = frames.groupBy("movie").agg(F.count("*").alias("count"))
    m = movies.join(count, "movie")
    few = (F.lit(rate) > 0) & (F.col("count") >= 2) & (F.col("p") >= F.col("q") * F.col("count"))
    m = m.withColumns({"q": F.when(few, F.lit(2)).otherwise(F.col("q")).cast("bigint"), "p": F.when(few, F.col("count")).otherwise(F.col("p")).cast("bigint")})
    f = frames.join(m.select("movie", "p", "q"), "movie").withColumn("chunk", chunk_of(F.col("frame_no"), F.col("p"), F.col("q")))
    c = f.groupBy("movie", "chunk").agg(F.min("frame_no").alias("first"), F.count("*").alias("frames"), F.sum("size").alias("_v"))
    at = lambda frame: F.floor((2 * frame * fps[1] * rate + fps[0]) / (2 * fps[0])).cast("bigint")
    c = c.select("movie", "chunk", "first", "frames", "_v", (F.col("_v") + F.col("_v") % 2).alias("video"), at(F.col("first")).alias("s0"), at(F.col("first") + F.col("frames")).alias("s1"))
    c = c.withColumn("sound", (F.col("s1") - F.col("s0")) * sample_bytes).withColumn("_n", F.ceil((F.col("video") + F.col("sound")) / SECTOR) * SECTOR)
    add = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"))
    c = prefix_scan(c, ["movie"], "chunk", F.struct(F.col("_n").alias("n")), add, F.struct(F.lit(0).cast("bigint").alias("n")), "_before")
    c = kept(c.withColumn("_before", F.col("_before.n")), "movie-chunks")
    largest = lambda odd: F.coalesce(F.max(F.when((F.col("chunk") % 2 == odd) & (F.col("video") + F.col("sound") > 0), F.col("video") + F.col("sound") + 1)), F.lit(0))
    own = c.groupBy("movie").agg(F.count("*").alias("chunks"), F.max("frames").alias("_most"), largest(0).alias("even_bytes"), largest(1).alias("odd_bytes"))
    m = m.join(own, "movie")
    nominal = F.col("p") / F.col("q")
    shown = F.when((F.lit(rate) > 0) & (F.col("_most") > nominal), F.col("_most").cast("string")).when(F.col("p") % F.col("q") == 0, F.floor(nominal).cast("string")).otherwise(F.regexp_replace(F.format_number(nominal, 6), r"0+$", ""))
    fields = {n: F.col(f"fields.{n}") for n in movies.schema["fields"].dataType.names} | {"frames_per_chunk": shown, "last_chunk": F.col("chunks") - 1, "even_bytes": F.col("even_bytes"), "odd_bytes": F.col("odd_bytes")}
    # the header tells its own length: the first number of digits that fits
    bare = F.octet_length(F.encode(render_header(fields | {"catalogue_offset": F.lit("")}), "ISO-8859-1"))
    m = m.withColumn("catalogue_offset", F.coalesce(*[F.when(F.length((bare + k).cast("string")) == k, bare + k) for k in range(1, 9)]).cast("bigint"))
    m = m.withColumn("header", F.encode(render_header(fields | {"catalogue_offset": F.col("catalogue_offset")}), "ISO-8859-1"))
    m = m.withColumn("_first", (F.ceil((F.col("catalogue_offset") + F.col("chunks") * LINE) / SECTOR) * SECTOR).cast("bigint"))
    # the first sector behind the catalogue, whose lines grow with the sector's own place
    line = lambda k: F.length(catalogue_line(F.col("_first") + k * SECTOR + F.col("_before"), F.col("video"), F.col("sound"), rate > 0))
    sizes = c.join(m.select("movie", "_first"), "movie").groupBy("movie").agg(*[F.sum(line(k)).alias(f"_l{k}") for k in range(MORE)])
    m = m.join(sizes, "movie")
    fits = [F.when(F.col("catalogue_offset") + F.col(f"_l{k}") <= F.col("_first") + k * SECTOR, F.struct((F.col("_first") + k * SECTOR).alias("at"), F.col(f"_l{k}").alias("n"))) for k in range(MORE)]
    m = m.withColumn("_fit", F.coalesce(*fits, F.raise_error(F.lit("a catalogue that does not fit")).cast("struct<at:bigint,n:bigint>")))
    m = m.select("movie", "header", "catalogue_offset", "chunks", F.col("_fit.at").alias("first_data"), F.col("_fit.n").alias("catalogue_bytes"))
    return c.join(m, "movie").withColumn("file_offset", F.col("first_data") + F.col("_before")).drop("_before", "_n")


def catalogue_line(offset: Column, video: Column, sound: Column, has_sound: bool) -> Column:
    return F.concat(offset.cast("string"), F.lit(","), video.cast("string"), F.lit(";"), sound.cast("string") if has_sound else F.lit("0"), F.lit("\n"))


def write_movies(frames: DataFrame, sound: DataFrame | None, movies: DataFrame, path: str, fps: tuple[int, int], rate: int = 0, sample_bytes: int = 1, piece: int = 65536, overwrite: bool = False) -> DataFrame:
    """Write a movie file of each movie, its parts streamed in order, and return the table of chunks.

    ``frames`` is (movie, frame_no from 0, body); ``sound`` is (movie, piece, body), the track's bytes in pieces of ``piece``
    bytes from 0, without gaps. Sound that ends early goes on as silence; what is left of it behind the last frame is not
    written. A frame without a body has no bytes. Files are named by the movie.
    """
    sized = frames.select("movie", F.col("frame_no").cast("bigint").alias("frame_no"), F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint").alias("size"))
    rate = rate if sound is not None else 0
    c = kept(chunk_table(sized, movies, fps, rate, sample_bytes), "movie-layout")
    place = lambda section, chunk, kind, no: [F.lit(section).alias("section"), chunk.cast("bigint").alias("chunk"), F.lit(kind).alias("kind"), no.cast("bigint").alias("no")]
    zero = F.lit(0)
    first = c.where("chunk = 0")
    rows = first.select("movie", *place(0, zero, 0, zero), F.col("header").alias("body"))
    rows = rows.union(c.select("movie", *place(1, F.col("chunk"), 0, zero), F.encode(catalogue_line(F.col("file_offset"), F.col("video"), F.col("sound"), rate > 0), "US-ASCII")))
    rows = rows.union(first.select("movie", *place(2, zero, 0, zero), _zeros(F.col("first_data") - F.col("catalogue_offset") - F.col("catalogue_bytes"))))
    spans = c.select("movie", "chunk", F.explode(F.sequence("first", F.col("first") + F.col("frames") - 1)).alias("frame_no"))
    rows = rows.union(frames.join(spans, ["movie", "frame_no"]).select("movie", *place(3, F.col("chunk"), 0, F.col("frame_no")), "body"))
    rows = rows.union(c.select("movie", *place(3, F.col("chunk"), 1, zero), _zeros(F.col("video") - F.col("_v"))))
    if rate:
        b0, b1 = F.col("s0") * sample_bytes, F.col("s1") * sample_bytes
        asked = c.where("sound > 0").select("movie", "chunk", b0.alias("b0"), b1.alias("b1"), F.explode(F.sequence(F.floor(b0 / piece), F.floor((b1 - 1) / piece))).alias("piece"))
        begin = F.greatest(F.lit(0), F.col("b0") - F.col("piece") * piece)
        want = F.least(F.lit(piece), F.col("b1") - F.col("piece") * piece) - begin
        cut = asked.join(sound, ["movie", "piece"], "left")
        part = F.coalesce(F.substring(F.col("body"), (begin + 1).cast("int"), want.cast("int")), _zeros(zero))
        rows = rows.union(cut.select("movie", *place(3, F.col("chunk"), 2, F.col("piece")), F.concat(part, _zeros(want - F.octet_length(part)))))
    behind = F.pmod(-(F.col("video") + F.col("sound")), F.lit(SECTOR))
    rows = rows.union(c.where("chunk < chunks - 1").select("movie", *place(3, F.col("chunk"), 3, zero), _zeros(behind)))
    write_files(rows, path, F.col("movie").cast("string"), [F.col(n) for n in ("section", "chunk", "kind", "no")], F.col("body"), overwrite)
    return c


def write_wavs(samples: DataFrame, path: str, rate: int, channels: int, overwrite: bool = False) -> None:
    """Write a sound file of each track of ``samples`` (track, order, body of sixteen-bit samples)."""
    rows = wav_rows(samples, "track", bits.wav_header(F.col("n"), rate, channels))
    write_files(rows, path, F.concat(F.col("track").cast("string"), F.lit(".wav")), [F.col("order")], F.col("body"), overwrite)
