"""Secret scans with DataFrame operations only: known shapes by pattern, others by a battery of randomness tests.

A candidate is a run of 20 or more characters of an encoding's alphabet with letters and digits. Its alphabet (hex, 36
or 64 characters) is inferred, its characters become codes, and three tests ask how far the codes are from uniformly
random ones: chi-squared on the code counts, runs above and below the alphabet's middle, and lag-one serial
correlation. The smallest p-value, corrected for three tests, is the candidate's statistic: near one for random keys,
tiny for ordinary text.

What is reported is controlled by the false-discovery rate against ordinary text. For the strata of alphabet and length
class that candidates have, the whole prose of every text of the corpus is cut into probes of that length, and the probes'
statistics are the stratum's null distribution; without candidates there are no probes. A candidate's p-value is the share of probes in
its stratum that look as random as it does, and the Benjamini-Hochberg rule at level ``fdr`` decides per stratum which
candidates are not ordinary text: these are the secrets. Strata make the decision length-aware: where runs are too short
to tell keys from prose, many probes look random and nothing is reported. The rule works on statistics in bins, counted
over all candidates and probes; the thresholds, one per stratum and so a few, are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmloom.llm._shared import written

# fixed values: the three base shapes
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs of AKIA[A-Z0-9]+ of 20 or more
HEX = r"[0-9a-f]{24,}"  # runs of [0-9a-f]+ of 24 or more
MIN_VALUE = 6

MIN_RUN = 20
RUN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{{{MIN_RUN}}})[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*+"
ALPHABETS = {"hex": "0123456789abcdef", "36": "0123456789abcdefghijklmnopqrstuvwxyz", "64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Length classes begin here; every candidate is judged by all its characters.
CLASSES = (20, 24, 32, 48, 96)
#: Statistics are ranked in bins of a quarter of a factor two, down to 2^-BINS/4.
BINS = 400
#: Matches whose lengths are added up one after another; blocks of them are offset by a second sum over the blocks.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running_ends(lengths: Column) -> Column:
    """The running sums of an array of ints, in two levels, so that no array grows element by element beyond a block."""
    fold = lambda xs, start: F.slice(F.aggregate(xs, F.array(start), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))), 2, 1 << 30)

    def blocked(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(own) - 1), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: F.slice(own, at + 1, BLOCK))

        def offset(b: Column) -> Column:
            sums = F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
            return F.flatten(F.zip_with(b, F.concat(F.array(F.lit(0)), fold(sums, F.lit(0))), lambda x, base: F.coalesce(fold(x, base), F.array().cast("array<int>"))))

        return bound(blocks, offset)

    return F.when(F.size(lengths) > 0, bound(lengths, blocked)).otherwise(F.array().cast("array<int>"))


def found(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Array of (at, ord, kind, until, hit) of the leftmost non-overlapping matches; code points, end exclusive."""
    both = rf"(?s)(?:.*?)({pattern})|.+"
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(both), F.lit(0)).alias("upto"), F.regexp_extract_all(text, F.lit(both), F.lit(1)).alias("hit"))

    def placed(own: Column) -> Column:
        ends = running_ends(F.transform(own, lambda x: F.length(x["upto"])))
        row = lambda x, end: F.struct((end - F.length(x["hit"])).alias("at"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("until"), x["hit"].alias("hit"))
        return F.filter(F.zip_with(own, ends, row), lambda m: m["hit"] != "")

    return bound(parts, placed)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the Abramowitz-Stegun form 26.2.17 (error below 1e-7)."""

    def tail(v: Column, a: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return bound(F.exp(-a * a / 2) / 2.5066282746310002 * bound(1 / (1 + 0.2316419 * a), poly), lambda p: F.when(v >= 0, p).otherwise(1 - p))

    return bound(z, lambda v: bound(F.abs(v), lambda a: tail(v, a)))


def inferred(s: Column) -> Column:
    """The smallest alphabet that the string's characters come from."""
    return F.when(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(s.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), "36").otherwise("64")


def scored(s: Column, enc: Column) -> Column:
    """Struct (enc, n, k, x): a string's alphabet, length, alphabet size and codes."""
    k = F.when(enc == "hex", 16).when(enc == "36", 36).otherwise(64)
    plain = F.translate(F.when(enc == "64", s).otherwise(F.lower(s)), "-_", "+/")
    alpha = F.when(enc == "hex", ALPHABETS["hex"]).when(enc == "36", ALPHABETS["36"]).otherwise(ALPHABETS["64"])
    n = F.length(s)
    return F.struct(enc.alias("enc"), n.alias("n"), k.alias("k"), F.transform(F.split(plain, ""), lambda c: F.instr(alpha, c) - 1).alias("x"))


def battery(c: Column) -> Column:
    """p-value of the three tests on a struct of ``scored``."""
    n, k, x = c["n"].cast("double"), c["k"].cast("double"), c["x"]
    dsum = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)

    def counted(s: Column, v: Column) -> Column:
        """A run of equal codes in order: the sum of squared counts grows by twice the run's length less one."""
        run = F.when(v == s["last"], s["run"] + 1).otherwise(1)
        return F.struct(v.alias("last"), run.alias("run"), (s["sum"] + 2 * run - 1).alias("sum"))

    squares = F.aggregate(F.array_sort(x), F.struct(F.lit(-9).alias("last"), F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("sum")), counted)["sum"].cast("double")
    chi = squares * k / n - n
    z1 = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    neighbours = lambda arr, f: F.zip_with(F.slice(arr, 1, F.greatest(F.lit(1), c["n"] - 1)), F.slice(arr, 2, F.greatest(F.lit(1), c["n"] - 1)), f)

    def runs(r: Column) -> Column:
        n1 = r["n1"].cast("double")
        spread = 2 * n1 * (n - n1)
        var = spread * (spread - n) / (n * n * (n - 1))
        return F.when(var > 0, F.abs(r["turns"] + 1 - (1 + spread / n)) / F.sqrt(var)).otherwise(F.lit(9.0))

    ones = lambda h: F.aggregate(h, F.lit(0), lambda s, v: s + v)
    turns = lambda h: F.aggregate(neighbours(h, lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    z2 = bound(F.transform(x, lambda v: (v * 2 >= c["k"]).cast("int")), lambda h: bound(F.struct(ones(h).alias("n1"), turns(h).alias("turns")), runs))

    def serial(dev: Column) -> Column:
        sums = F.struct(dsum(neighbours(dev, lambda a, b: F.coalesce(a * b, F.lit(0.0)))).alias("top"), dsum(F.transform(dev, lambda v: v * v)).alias("below"))
        return bound(sums, lambda r: F.when(r["below"] > 0, F.abs(r["top"] / r["below"]) * F.sqrt(n)).otherwise(F.lit(9.0)))

    z3 = bound(F.aggregate(x, F.lit(0).cast("bigint"), lambda s, v: s + v).cast("double") / n, lambda m: bound(F.transform(x, lambda v: v - m), serial))
    p = F.least(upper_tail(z1), 2 * upper_tail(z2), 2 * upper_tail(z3)) * 3
    return F.greatest(F.lit(1e-30), F.least(F.lit(1.0), p))


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-4 * F.log2(p))).cast("int")


def stratum(enc: Column, n: Column) -> Column:
    size = F.lit(CLASSES[0])
    for low in CLASSES[1:]:
        size = F.when(n >= low, low).otherwise(size)
    return F.concat_ws("/", enc, size.cast("string"))


def probes(docs: DataFrame, text: Column, strata: list[str]) -> DataFrame:
    """Rows (stratum, bin): what the tests say of the prose of every text of ``docs``, cut whole into strings for each of ``strata``.

    The characters of the alphabet in a text's prose, in their order, are cut one string after another at the class's
    length; the rest at the end that is shorter is none.
    """
    prose = F.regexp_replace(text, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "")  # words with digits may be candidates

    def cut(p: Column, enc: str, other: str) -> Column:
        sizes = [n for n in CLASSES if f"{enc}/{n}" in strata]
        strings = lambda s: F.flatten(F.array(*[F.regexp_extract_all(s, F.lit(f".{{{n}}}"), F.lit(0)) for n in sizes]))
        return F.transform(bound(F.regexp_replace(p, other, ""), strings), lambda x: F.struct(F.lit(enc).alias("enc"), x.alias("s")))

    wanted = [(enc, other) for enc, other in (("hex", "[^0-9a-f]"), ("36", "[^0-9a-z]"), ("64", "[^A-Za-z0-9+/]")) if any(x.startswith(f"{enc}/") for x in strata)]
    d = docs.select(F.explode(bound(prose, lambda p: F.flatten(F.array(*[cut(p, *x) for x in wanted])))).alias("p"))
    return d.select(bound(scored(F.col("p.s"), F.col("p.enc")), lambda c: F.struct(stratum(c["enc"], c["n"]).alias("stratum"), _bin(battery(c)).alias("bin"))).alias("r")).select("r.stratum", "r.bin")


def secret_spans(docs: DataFrame, fdr: float = 0.05, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: _key (its columns but the text, in a struct), base and spans, arrays of (at, ord, kind, until).

    ``base`` holds kinds assign, access and hex, by start and then in this order; ``spans`` adds kind random, where no
    base span overlaps. Null and empty texts have no spans and no probes; repeated rows stay; every length of text is
    scanned whole; an empty table gives an empty result. Other columns may have any name, as they stay inside _key.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    empty = F.array().cast("array<struct<at:int,ord:int,kind:string,until:int,hit:string>>")
    found_in = lambda pattern, kind, order: F.coalesce(found(F.when(F.regexp_like(text, F.lit(pattern)), text), pattern, kind, order), empty)
    assign = F.filter(found_in(ASSIGN.replace("([A-Za-z0-9", "(?:[A-Za-z0-9"), "assign", 0), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 1)) >= MIN_VALUE)
    runs = F.filter(found_in(RUN, "random", 3), lambda m: (F.length(m["hit"]) >= MIN_RUN) & m["hit"].rlike("[A-Za-z]"))
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).alias("_")]).alias("_key")
    d = docs.select(key, F.array_sort(F.concat(assign, found_in(ACCESS, "access", 1), found_in(HEX, "hex", 2))).alias("base"), runs.alias("runs"))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["at"] < r["until"]) & (r["at"] < b["until"])))

    def judged(r: Column) -> Column:
        return bound(scored(r["hit"], inferred(r["hit"])), lambda c: F.struct(r["at"].alias("at"), r["ord"].alias("ord"), r["kind"].alias("kind"), r["until"].alias("until"), stratum(c["enc"], c["n"]).alias("stratum"), _bin(battery(c)).alias("bin")))

    d = d.select("_key", F.transform("base", lambda b: b.dropFields("hit")).alias("base"), F.transform(free, judged).alias("runs"))
    d = written(d, "secret-candidates")
    candidates = d.select(F.explode("runs").alias("r")).select("r.stratum", "r.bin")
    strata = [r["stratum"] for r in candidates.select("stratum").distinct().collect()]  # a few: alphabets by length classes
    limits = thresholds(candidates, probes(docs, text, strata), fdr) if strata else {}

    def limit(of: Column) -> Column:
        out = F.lit(-1)
        for name, last in sorted(limits.items()):
            out = F.when(of == name, last).otherwise(out)
        return out

    secret = F.filter("runs", lambda r: r["bin"] <= limit(r["stratum"]))
    more = F.transform(secret, lambda r: F.struct(r["at"].alias("at"), r["ord"].alias("ord"), r["kind"].alias("kind"), r["until"].alias("until")))
    return d.select("_key", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def thresholds(candidates: DataFrame, null: DataFrame, fdr: float) -> dict[str, int]:
    """Per stratum the last bin that is reported: Benjamini-Hochberg over (stratum, bin) of candidates, their p-values from ``null``."""
    n = candidates.groupBy("stratum", "bin").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("m"))
    m = null.groupBy("stratum", "bin").agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("m"))
    counts = n.union(m).groupBy("stratum", "bin").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    every = Window.partitionBy("stratum")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("stratum", "bin", F.col("n"), F.sum("n").over(upto).alias("rank"), F.sum("n").over(every).alias("all"), ((F.sum("m").over(upto) + 1) / (F.sum("m").over(every) + 1)).alias("p"))
    rejected = ranked.where((F.col("rank") > 0) & (F.col("p") <= fdr * F.col("rank") / F.col("all"))).groupBy("stratum").agg(F.max("bin").alias("last"))
    return {r["stratum"]: r["last"] for r in rejected.collect()}


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["until"].cast("string"))), ",")
