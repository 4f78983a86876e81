"""op11 against scores of every document with every item, one by one."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from filmloom.llm import lexical
from filmloom.llm.lexical import impacts, ranked

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top):
    docs = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    out = []
    for item, text in set(items):
        asked, scores = set(terms(text)), []
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in docs) + 1))) for t in asked}
        for i, w in docs:
            if w:
                m = 100 - 50 + (50 * len(w) * n_docs) // total
                s = sum(weight[t] * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in asked)
                if s > 0:
                    scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "x_y", "日本", "A1b2"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(rng.randrange(400), " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 20, 60, 400])))) for _ in range(300)]
    docs += [(1000 + i, "w3 w5 W7 copied text") for i in range(120)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w3 w5 w7"), (None, None), (2, None), (3, ""), (4, "... --")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 40])))) for k in range(25)]
    return docs, items + [items[0], (1, "w3 w5 w7"), (None, "w9 w3"), (90, None), (91, ""), (92, "unheard of")]


@pytest.mark.parametrize(("top", "seeds", "block_terms", "similar"), [(50, 4096, 60_000, 0.9), (5, 3, 60_000, 0.9), (3, 20, 100, 0.99)])
def test_brute_force(spark, monkeypatch, top, seeds, block_terms, similar):
    monkeypatch.setattr(lexical, "SIMILAR", similar)
    docs, items = corpus(top)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("clash")).withColumn("score", F.lit(1)).repartition(4)
    got = ranked(d, spark.createDataFrame(items, "item_id long, text string"), top, block_terms=block_terms, seeds=seeds)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, top)


def test_buckets_and_bounds_prune(monkeypatch):
    import numpy as np
    import pyarrow as pa

    s = lexical.Searcher([np.array([0, 1]), np.array([2])], np.array([100, 50, 10]), 1, np.array([10**9, 0]))
    row, term, impact = np.array([0, 1, 2]), np.array([0, 1, 2]), np.array([1000, 900, 800])
    assert s.bucket(pa.array([1, 2, 3]), row, term, impact, np.array([1000.0, 900.0, 800.0]))
    assert s.best[0].rows == []  # no vector of the bucket is long enough
    assert s.best[1].rows == [(8000, 3)]
    assert not s.bucket(pa.array([4]), np.array([0]), np.array([2]), np.array([700]), np.array([700.0]))


def test_edges(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    assert ranked(docs, items).count() == 0
    assert ranked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.where("item_id > 1")).count() == 0
    got = ranked(spark.createDataFrame([("x", "a " * 300_000), ("y", "b c")], "doc_id string, text string"), items)
    assert [(r["doc_id"], r["rank"]) for r in got.orderBy("rank").collect()] == [("x", 1), ("y", 2)]


def test_wide_integers():
    import numpy as np

    n, tf = np.array([10**9, 5]), np.array([3, 1])
    assert impacts(tf, n, 10**11, 10**13).tolist() == [1_000_000_000 * 3 // (3000 + 20 * (50 + 50 * 10**9 * 10**11 // 10**13)), 1_000_000_000 // (1000 + 20 * (50 + 50 * 5 * 10**11 // 10**13))]


def test_sql(spark):
    import duckdb

    from filmloom.llm.q_lexical import OP11_SQL, op11_lexical_search

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = op11_lexical_search(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(OP11_SQL).project("item_id, rank, doc_id, score").fetchall())
