"""op7: later copies of repeated line runs in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm.line_dedup import marked
from filmloom.llm.registry import query, table

MIN_WORDS = 50


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_deleted, deleted_words, deleted (places of lines, comma-joined), kept_sha256."""
    m = marked(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_WORDS)
    return m.select(
        "doc_id", F.col("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_deleted"),
        F.coalesce("gone_words", F.lit(0)).cast("bigint").alias("deleted_words"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("deleted"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )
