"""op1: near-duplicate components over 3-word shingles at Jaccard 0.9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm.ngram_join import jaccard_components
from filmloom.llm.registry import query, table

SHINGLE, PERCENT = 3, 90


@query("op1_ngram_join")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    j = jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), SHINGLE, PERCENT)
    return j.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")
