"""op9: token counts of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm.registry import query, table
from filmloom.llm.token_counts import with_token_counts

LIMIT = 4096


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. A null text is empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = with_token_counts(docs, model_path())
    return n.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
