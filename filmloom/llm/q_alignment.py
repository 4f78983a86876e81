"""op13: alignment of two tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filmloom.llm.alignment import aligned
from filmloom.llm.q_packing import tokenizer_path
from filmloom.llm.q_token_counts import model_path
from filmloom.llm.registry import query, table


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), model_path()).documents
