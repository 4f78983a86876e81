"""License scans with DataFrame operations only: an exact set-containment join of text blocks with license templates.

Notices may be wrapped over any number of lines and stand anywhere in a text, so blocks are stretches of words: around
every word by which a template may be found, somewhat more than the template's length to either side. A template is
found in a block that holds at least ``threshold`` of the template's distinct words.
Words are ordered by how many texts of the whole corpus hold them, rarest first. If a block meets the threshold, it
holds one of the template's first n - ceil(threshold n) + 1 words in that order (prefix filter), at least
ceil(threshold n) words (length filter), and from the first common prefix word on enough words are left in both
(positional filter). Blocks with a prefix word are joined to templates on that word, filtered, and verified in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.llm._shared import written

# fixed values: base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: notices that the templates are made of, in words
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-by": "licensed under cc by",
    "cc-by-sa": "licensed under a creative commons attribution sharealike license",
    "cc-by-cc": "this work is licensed under a creative commons attribution international license",
    "gpl": "licensed under the gnu general public license version",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "licensed under the gnu lesser general public license version",
    "lgpl-grant": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "reserved": "copyright all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
#: Templates that carry another label than their name.
LABEL_OF = {"cc-by-cc": "cc-by", **{k: k.split("-")[0] for k in ("apache-header", "apache-basis", "bsd-disclaimer", "gpl-grant", "gpl-warranty", "lgpl-grant", "mit-text", "mit-disclaimer")}}
_ASCII = "".join(map(chr, range(128)))
_FLAT = "".join(c.lower() if c.isalnum() else " " for c in _ASCII)


def word_list(text: Column) -> Column:
    """The words of ``text``: runs of ASCII letters, digits and all characters beyond ASCII; A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _ASCII[1:], _FLAT[1:]), r"[\x00 ]"), "")


def reach_of(words: list[str]) -> int:
    """How many words to either side of a template's word its block has."""
    return max(len(words) + 3, math.ceil(1.25 * len(words)))


def template_words(docs: DataFrame, text_col: str, templates: dict[str, str]) -> dict[str, int]:
    """How many texts hold each template word. One row per template word reaches the driver, whatever the corpus."""
    vocab = sorted({w for t in templates.values() for w in t.split()})
    seen = F.array_intersect(word_list(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.array(*map(F.lit, vocab)))
    got = docs.select(F.explode(seen).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r["w"]: r["n"] for r in got.collect()}
    return {w: counts.get(w, 0) for w in vocab}


def prefix_index(freq: dict[str, int], templates: dict[str, str], threshold: float) -> list[tuple[str, str, list[str], int, int]]:
    """(prefix word, template, its distinct words in the global order, how many a block needs, the prefix word's place)."""
    index = []
    for name, t in sorted(templates.items()):
        own = sorted(set(t.split()), key=lambda w: (freq[w], w))
        need = math.ceil(threshold * len(own) - 1e-9)
        index += [(w, name, own, need, i) for i, w in enumerate(own[: len(own) - need + 1])]
    return index


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def start(w: Column, i: Column) -> Column:
        hit = w == first
        for k, x in enumerate(rest, 1):
            hit &= F.get(words, i + k) == x
        return F.when(hit, i)

    every = F.filter(F.transform(words, start), lambda i: i.isNotNull())
    there = F.array_contains(words, first)
    for x in rest:
        there &= F.array_contains(words, x)
    return F.when(there, every).otherwise(F.array().cast("array<int>"))


def _blocks(words: Column, reach: dict[str, int], vocab: list[str]) -> Column:
    """The distinct words of ``vocab`` around every word in ``reach``, as many words to either side as stand there."""
    far = F.create_map(*[x for w, n in sorted(reach.items()) for x in (F.lit(w), F.lit(n))])

    def around(w: Column, i: Column) -> Column:
        begin = F.greatest(F.lit(0), i - far[w])
        return F.when(w.isin(*reach), F.array_intersect(F.slice(words, begin + 1, i - begin + 1 + far[w]), F.array(*map(F.lit, vocab))))

    return F.array_distinct(F.filter(F.transform(words, around), lambda x: x.isNotNull()))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.9, text_col: str = "text") -> DataFrame:
    """Per row: _key (its columns but the text, in a struct), n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places are where a base phrase's words stand consecutively; first_word and last_word are their smallest and
    largest start, null if there is none. ``labels`` adds those of templates found in a block; ``score`` is 1 with a base
    place, else the largest containment found, else 0. Null and empty texts have no words and score 0; texts of any
    length are scanned whole; repeated rows stay, each with its own result; an empty table gives an empty result. Other
    columns may have any name, as they stay inside _key.
    """
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    freq = template_words(docs, text_col, templates)
    index = prefix_index(freq, templates, threshold)
    order = sorted(freq, key=lambda w: (freq[w], w))
    prefix_words = sorted({r[0] for r in index})
    reach = {w: max(reach_of(templates[r[1]].split()) for r in index if r[0] == w) for w in prefix_words}
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).alias("_")]
    d = docs.select(F.struct(*rest).alias("_key"), word_list(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_w"))
    found = F.arrays_overlap("_w", F.array(*map(F.lit, prefix_words)))
    d = d.select(
        "_key",
        F.size("_w").cast("bigint").alias("n_words"),
        F.struct(*[_places(F.col("_w"), p).alias(label) for p, label in PHRASES.items()]).alias("_n"),
        F.when(found, _blocks(F.col("_w"), reach, order)).otherwise(F.array().cast("array<array<string>>")).alias("_blocks"),
    )
    d = written(d, "license-blocks")
    # equal rows share their blocks' result; blocks hold template words only, so they are few and short
    row = F.struct("_key", F.xxhash64("_blocks").alias("h"))
    blocks = d.where(F.size("_blocks") > 0).select(row.alias("row"), F.explode("_blocks").alias("words")).distinct()
    place = F.create_map(*[x for i, w in enumerate(order) for x in (F.lit(w), F.lit(i))])
    blocks = blocks.select("row", F.size("words").alias("size"), F.array_sort(F.transform("words", lambda w: place[w])).alias("own"))
    tokens = blocks.select("*", F.posexplode("own").alias("i", "token"))
    at = {w: i for i, w in enumerate(order)}
    temps = spark.createDataFrame(
        [(at[w], name, [at[x] for x in own_words], need, len(own_words), j) for w, name, own_words, need, j in index],
        "token int, template string, words array<int>, need int, n int, j int",
    )
    pairs = tokens.join(F.broadcast(temps), "token").where(F.col("size") >= F.col("need"))
    left = F.least(F.size("own") - F.col("i"), F.col("n") - F.col("j"))  # both are in the global order
    pairs = pairs.where(left + F.col("j") >= F.col("need"))
    met = pairs.withColumn("overlap", F.size(F.array_intersect("own", "words"))).where(F.col("overlap") >= F.col("need"))
    label = F.create_map(*[x for k in sorted(templates) for x in (F.lit(k), F.lit(LABEL_OF.get(k, k)))])
    more = met.groupBy("row").agg(F.collect_set(label[F.col("template")]).alias("more"), F.max(F.col("overlap") / F.col("n")).alias("best"))
    out = d.join(more, row.eqNullSafe(more["row"]), "left")
    places = [F.col(f"_n.`{v}`") for v in PHRASES.values()]
    base = F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(v)) for p, v in zip(places, PHRASES.values(), strict=True)]), lambda x: x.isNotNull())
    every = F.concat(*places)
    all_labels = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        "_key", "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
