"""op12 against a plain decomposition of the tokenizer's own ids."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom.llm._tokens import ByteBPE, PieceBPE, safe_cuts
from filmloom.llm.packing import lengths, packed
from filmloom.llm.q_packing import op12_packing, tokenizer_path
from filmloom.llm.q_token_counts import model_path

ROWS = [(1, "Hello there, world."), (2, None), (3, ""), (1, "Hello there, world."), (1, "another"), (None, "no id"), (5, "<|endoftext|> in a text  \n"), (6, "word " * 5000), (7, "tab\t\n    x　y " * 40), (8, "a" * 3000)]


def own_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("longest", [2048, 64, 1])
def test_pieces(spark, longest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("length", F.lit("clash")).repartition(3)
    got = packed(docs, tokenizer_path(), longest).collect()
    want = []
    for doc, text in ROWS:
        ids, start = own_ids(text), 0
        n = len(ids)
        while start < n:
            size = longest
            while size > n - start:
                size //= 2
            want.append((doc, start, size, np.array(ids[start : start + size], "<u4").tobytes(), n))
            start += size
    key = lambda r: (str(r[0]), r[4], r[1], r[3])
    assert sorted(((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got), key=key) == sorted(want, key=key)
    by_number = sorted(got, key=lambda r: r["sequence_id"])
    assert [r["sequence_id"] for r in by_number] == list(range(len(want)))
    assert [r["length"] for r in by_number] == sorted((w[2] for w in want), reverse=True)
    assert {r["offset"] for r in got} == {0}


def test_edges(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
    assert lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    with pytest.raises(ValueError):
        packed(spark.range(1).withColumn("text", F.lit("x")), tokenizer_path(), 100, id_col="id")


def test_long_texts_are_cut_safely(spark, monkeypatch):
    import filmloom.llm.packing as packing

    text = "It's  a\ttab \n  line -- 3.5  　x <|endoftext|> 's " * 50
    whole = own_ids(text)
    monkeypatch.setattr(packing, "STEP", 7)
    assert packing.token_ids(ByteBPE(tokenizer_path(), False), text, 1).tolist() == whole
    b, blob = PieceBPE(model_path()), (" " + text).encode()
    cuts = [0, *safe_cuts(blob, 5).tolist(), len(blob)]
    assert len(cuts) > 100
    assert [i for p, q in zip(cuts, cuts[1:], strict=False) for i in b.ids(blob[p + 1 : q].decode()).tolist()] == b.ids(text).tolist()


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_packing(spark, str(tmp_path)).collect()
    ids = {k: own_ids(t) for k, t in [(6, "word " * 5000), (8, "a" * 3000)]}
    for r in got:
        if r["doc_id"] in ids:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert sum(r["length"] for r in got) == sum(len(own_ids(t)) for _, t in ROWS)
