"""Choices are made inside the training rows: held-out rows change nothing."""

from pyspark.sql import functions as F

from filmloom.llm import lm, toxicity
from filmloom.llm.tuning import lm_folds, toxicity_folds


def test_held_out_rows_take_no_part(spark):
    docs = [(i, f"plain words number {i % 7} of a text {'you scumbag idiot ' * 2 if i % 3 == 0 else ''} and more words {i % 5}") for i in range(240)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    out = lm.held_out(F.col("doc_id"))
    other = d.withColumn("text", F.when(out, F.lit("something else")).otherwise(F.col("text")))
    worths = [(100.0, 3.0), (10.0, 3.0)]
    assert lm_folds(d, worths) == lm_folds(other, worths)
    hidden = toxicity.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(hidden, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    choices = {"as it is": {}, "none": {"misspelled": 0.0}}
    got = toxicity_folds(d, labels, choices)
    assert got == toxicity_folds(d, flipped, choices)
    assert [r[0] for r in got] == list(choices)
    assert all(r[2] == r[1] and r[4] == 0 for r in got)
