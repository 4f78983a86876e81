"""op10: secrets in whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm.registry import query, table
from filmloom.llm.secrets import listed, secret_spans


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    s = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return s.select(
        F.col("_key.doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
