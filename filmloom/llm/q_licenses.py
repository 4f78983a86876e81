"""op6: license notices in whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filmloom.llm.licenses import license_scan
from filmloom.llm.registry import query, table


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    s = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return s.select("_key.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
