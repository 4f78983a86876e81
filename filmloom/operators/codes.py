"""Prefix codes as strings of bits, first bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(lengths: list[int]) -> list[str]:
    """The canonical code of each symbol: codes of a length are consecutive, shorter ones come first."""
    out, code, last = [""] * len(lengths), 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= n - last
        out[symbol], last = format(code, f"0{n}b"), n
        code += 1
        if code > 1 << n:
            raise ValueError("more codes than these lengths leave room for")
    return out


def check(codes: list[str]) -> None:
    """Raise a ValueError where a code is empty or begins another: neighbours in order tell."""
    order = sorted(codes)
    if not all(codes) or any(b.startswith(a) for a, b in zip(order, order[1:], strict=False)):
        raise ValueError("not a prefix code")


def written(symbols: Column, codes: list[str]) -> Column:
    """An array of symbols as a string of bits."""
    own = F.array(*map(F.lit, codes))
    return F.array_join(F.transform(symbols, lambda s: own[s.cast("int")]), "")


def read(bits: Column, codes: list[str]) -> Column:
    """The symbols of a string of bits, of blocks of symbols; null where it ends inside a code or holds none of them."""
    symbol = F.create_map(*[x for s, c in enumerate(codes) for x in (F.lit(c), F.lit(s))])
    most = max(map(len, codes))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<int>").alias("out"))

    def one(s: Column, bit: Column) -> Column:
        code = F.concat(s["open"], bit)
        found = symbol[code]
        return F.struct(F.when(found.isNull(), code).otherwise(F.lit("")).alias("open"), F.when(found.isNull() | (F.length(code) > most), s["out"]).otherwise(F.concat(s["out"], F.array(found))).alias("out"))

    return F.aggregate(F.filter(F.split(bits, ""), lambda b: b != ""), start, one, lambda s: F.when(s["open"] == "", s["out"]))
