"""op10: how many planted keys of each length and alphabet are found, and how many names are taken for keys."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from filmloom.llm.secrets import CLASSES, probes, secret_spans

ALPHABETS = {"hex": "0123456789ABCDEF", "36": "0123456789abcdefghijklmnopqrstuvwxyz", "64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
LENGTHS, EACH = (20, 24, 32, 40, 48, 64, 96), 15
WORDS = "the order report of train station morning paper market child window garden river stone answer letter people house about which because under summer light water music story".split()
NAMES = ["src/{}/{}_{}/{}2.py", "{}_{}_{}_{}_v2", "{}-{}-{}-{}-2024", "/home/{}/{}/{}/{}1"]


def test_recall_by_length_and_alphabet(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))

    def key(alphabet, n):
        while True:
            k = "".join(rng.choices(alphabet, k=n))
            if any(c.isdigit() for c in k) and any(c.isalpha() for c in k):
                return k

    planted = [(a, n) for a in ALPHABETS for n in LENGTHS for _ in range(EACH)]
    texts = [f"{prose(60)} {key(ALPHABETS[a], n)} {prose(200)}" for a, n in planted]
    texts += [f"{prose(60)} {rng.choice(NAMES).format(*rng.choices(WORDS, k=4))} {prose(200)}" for _ in range(150)]
    texts += [prose(300) for _ in range(2500)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = {r["_key"]["doc_id"] for r in secret_spans(d).collect() if any(s["kind"] == "random" for s in r["spans"])}
    recall = Counter(planted[i] for i in found if i < len(planted))
    for a in ALPHABETS:
        assert all(recall[a, n] >= 0.8 * EACH for n in LENGTHS if n >= 32), (a, recall)
    assert recall["hex", 20] + recall["64", 20] >= 1.6 * EACH  # of 36 characters the shortest class cannot be told from prose
    assert len([i for i in found if i >= len(planted)]) <= 0.1 * len(found)


def test_thresholds_come_from_all_prose(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    texts = [f"{prose(1500)} {''.join(rng.choices(ALPHABETS['64'], k=38))}x7 {prose(1500)}" for _ in range(3)]
    d = spark.createDataFrame([*enumerate(texts), (9, None), (10, "")], "doc_id long, text string")
    got = {r["_key"]["doc_id"]: [(s["at"], s["until"]) for s in r["spans"] if s["kind"] == "random"] for r in secret_spans(d).collect()}
    want = {i: [m.span() for m in re.finditer(r"\S{40}", t)] for i, t in enumerate(texts)}
    assert got == {**want, 9: [], 10: []}  # three texts, but hundreds of strings of their prose

    strata = [f"{e}/{n}" for e in ("hex", "36", "64") for n in CLASSES]
    n = Counter(r["stratum"] for r in probes(d, F.col("text"), strata).collect())
    plain = ["".join(w for w in t.split() if not re.search("[0-9]", w)) for t in texts]
    keep = {"hex": "[^0-9a-f]", "36": "[^0-9a-z]", "64": "[^A-Za-z0-9+/]"}
    assert n == {f"{e}/{k}": sum(len(re.sub(keep[e], "", p)) // k for p in plain) for e in keep for k in CLASSES}


def test_long_runs_are_judged_whole(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    key = "".join(rng.choices(ALPHABETS["64"], k=600)) + "a7"
    d = spark.createDataFrame([(i, f"{prose(1500)} {key + tail} {prose(1500)}") for i, tail in enumerate(["", "wxyz1" * 1000])], "doc_id long, text string")
    assert {r["_key"]["doc_id"] for r in secret_spans(d).collect() if r["spans"]} == {0}
