"""Line dedup: repeated line runs from a suffix array over line IDs, built by distributed prefix doubling.

Every non-blank line of every document is a position of one sequence of line IDs (hashes of the lines). Round k ranks
the suffixes by their first 2^k lines: round 0 by the line, round k + 1 by the pair of the rank of round k here and 2^k
lines further on. Ranks are dense places in that order, prefix sums over the sorted distinct pairs, taken in two levels:
inside ranges of the order, then over the ranges. With a rank goes its width, the number of suffixes that share it:
[rank, rank + width) is the interval of the suffix array whose longest common prefix is 2^k lines or more. Suffixes
whose interval has width one differ from all others by then and leave; the rounds end when none is left, or when 2^k
is more than a run of interest needs.

A run is deleted only if one earlier copy, by document id, has all of it and it has ``min_words`` words or more. Every
line of such a run lies in the shortest stretch of ``min_words`` words that begins at a line of the run or ends at one.
How long those are depends on their own lines alone, so copies have them at the same places. For a stretch of L lines,
2^k <= L < 2^(k+1), the ranks of round k at its first and at its last 2^k lines name the interval of longest common
prefix L: what shares both is a copy, and it is a later one if the first of the interval lies before. The lines of all
later copies are deleted. No stretch has more than ``min_words`` lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.llm._shared import forget, written


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, pos, line, name, words): non-blank lines, numbered per document; ``line`` is the place among all lines."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text_col).alias("row"), F.split(text, "\n").alias("ls"))
    at = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("line"), F.xxhash64(F.trim(x)).alias("name"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))), lambda s: s["words"] > 0)
    return own.select("row", "id", F.posexplode(at).alias("pos", "s")).select("row", "id", "pos", "s.line", "s.name", "s.words").dropDuplicates(["row", "pos"])


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def ranked(pairs: DataFrame, name: str) -> DataFrame:
    """(row, pos, rank, width) of the positions of ``pairs`` (row, pos, a, b) that share their pair with others.

    ``rank`` is how many of these have a smaller pair, ``width`` how many have this one.
    """
    keys = pairs.groupBy("a", "b").agg(F.count("*").alias("width")).where("width > 1")
    keys = keys.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("part", F.spark_partition_id())
    keys = written(keys, f"{name}-keys")
    # one row per range of the order
    parts = keys.groupBy("part").agg(F.sum("width").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    places = keys.withColumn("inside", F.coalesce(F.sum("width").over(inside), F.lit(0))).join(F.broadcast(parts), "part")
    places = written(places.select("a", "b", (F.col("base") + F.col("inside")).alias("rank"), "width"), f"{name}-places")
    forget(keys)
    out = written(pairs.join(places, ["a", "b"]).select("row", "pos", "rank", "width"), name)
    forget(places)
    return out


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """(row, id, pos, size): the shortest stretches of ``min_words`` words that begin or end at a line of a document."""
    by = Window.partitionBy("row").orderBy("pos")
    upto = lines.select("row", "id", "pos", "words", F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    before, least = F.col("upto") - F.col("words"), max(1, min_words)
    # how many lines begin before ``least`` words from a line's first, and not after ``least`` words back from its last
    asked = [F.struct((before + least).alias("at"), F.lit(0).alias("kind")), F.struct(before.alias("at"), F.lit(1).alias("kind")), F.struct((F.col("upto") - least).alias("at"), F.lit(2).alias("kind"))]
    got = upto.select("row", "id", "pos", "upto", F.explode(F.array(*asked)).alias("s")).select("row", "id", "pos", "upto", "s.at", "s.kind")
    inside = Window.partitionBy("row").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("n", F.sum((F.col("kind") == 1).cast("int")).over(inside).cast("int")).withColumn("total", F.max("upto").over(Window.partitionBy("row")))
    begin = F.when(F.col("kind") == 0, F.col("pos")).otherwise(F.col("n") - 1)
    end = F.when(F.col("kind") == 0, F.col("n")).otherwise(F.col("pos") + 1)
    got = got.where(((F.col("kind") == 0) & (F.col("at") <= F.col("total"))) | ((F.col("kind") == 2) & (F.col("at") >= 0)))
    return got.select("row", "id", begin.alias("pos"), (end - begin).alias("size")).distinct()


def later_copies(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, lines, n_words): per document with later copies the places of its lines to delete, and their words."""
    lines = written(line_table(docs, id_col, text_col), "lines")
    runs = written(stretches(lines, min_words), "stretches")
    pairs, rounds, found = lines.select("row", "pos", F.col("name").alias("a"), F.lit(0).cast("bigint").alias("b")), [], None
    while 1 << len(rounds) <= max(1, min_words):
        half = 1 << len(rounds)
        now = ranked(pairs, f"ranks-{len(rounds)}")
        rounds.append(now)
        if now.isEmpty():
            break
        here = runs.where((F.col("size") >= half) & (F.col("size") < 2 * half)).join(now.select("row", "pos", F.col("rank").alias("a")), ["row", "pos"])
        last = now.select("row", F.col("pos").alias("tail"), F.col("rank").alias("b"))
        here = here.withColumn("tail", F.col("pos") + F.col("size") - half).join(last, ["row", "tail"]).select("row", "id", "pos", "size", "a", "b")
        found = here if found is None else found.union(here)
        behind = now.select("row", (F.col("pos") - half).alias("pos"), F.col("rank").alias("b"))
        pairs = now.select("row", "pos", F.col("rank").alias("a")).join(behind, ["row", "pos"]).select("row", "pos", "a", "b")
    if found is None:
        return lines.limit(0).select("row", F.array("line").alias("lines"), F.col("words").cast("bigint").alias("n_words"))
    found = written(found, "repeated-stretches")
    for table in (*rounds, runs):
        forget(table)
    # the first of every interval; a copy that overlaps it in the same text is none
    place = F.struct(F.coalesce(F.col("id"), F.lit(2**63 - 1)).alias("id"), "row", "pos")
    firsts = written(found.groupBy("size", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first-copies")
    apart = (F.col("first.row") != F.col("row")) | (F.col("first.pos") + F.col("size") <= F.col("pos"))
    flagged = found.join(firsts, ["size", "a", "b"]).where((F.col("first") < place) & apart).select("row", "pos", "size")
    # stretches that overlap or touch are joined, so that every line is listed once
    by = Window.partitionBy("row").orderBy("pos", "size")
    reach = F.max(F.col("pos") + F.col("size")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    joined = flagged.withColumn("new", F.coalesce((F.col("pos") > reach).cast("int"), F.lit(1)))
    joined = joined.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("row", "run").agg(F.min("pos").alias("a"), F.max(F.col("pos") + F.col("size")).alias("b"))
    gone = joined.select("row", F.explode(F.sequence("a", F.col("b") - 1)).alias("pos"))
    out = gone.join(lines, ["row", "pos"]).groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.sum("words").cast("bigint").alias("n_words"))
    out = written(out, "later-copies")
    for table in (found, firsts, lines):
        forget(table)
    return out


def _marked(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with its columns as c0, c1, ..., and lines, gone, gone_words and kept."""
    gone = later_copies(docs, min_words, id_col, text_col).select("row", F.col("lines").alias("gone"), F.col("n_words").alias("gone_words"))
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], row_key(id_col, text_col).alias("row"))
    text = F.col(f"c{docs.columns.index(text_col)}")
    every = F.split(text, "\n")
    # the places that stay by a hash set, then their lines, so that a text with many deleted lines takes no longer
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("gone").cast("array<int>"))
    kept = F.transform(F.array(every), lambda ls: F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n"))[0]
    # what is gone grows with the documents, so it is merged at every size, never broadcast
    both = own.join(gone.hint("merge"), "row", "left").drop("row")
    return both.withColumn("lines", F.coalesce(F.size(every), F.lit(0))).withColumn("kept", F.when(F.col("gone").isNull(), text).otherwise(kept))


def marked(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lines (how many), gone (places of deleted ones), gone_words and kept (the text without them).

    Lines are compared without outer blanks; blank lines are never compared and stay. Rows equal in id and text are one
    document and get one result; of rows that share an id but not the text, each is compared for itself. A null text has
    no lines, an empty one a blank line. The first copy is the one with the smallest id, null last, in a text that
    repeats itself the first of those that do not overlap. A text without deleted lines is kept as it is, however long.
    Columns named like the new ones are replaced. An empty table gives an empty result.
    """
    new = ["lines", "gone", "gone_words", "kept"]
    return _marked(docs, min_words, id_col, text_col).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new], *new)


def without_repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of line runs deleted from the text; a document with nothing else in it goes altogether."""
    m = _marked(docs, min_words, id_col, text_col).where(F.col("gone").isNull() | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return m.select(*[F.col("kept" if c == text_col else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
