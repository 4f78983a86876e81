"""op2: the five nearest embeddings of every fiftieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm.registry import query, table
from filmloom.llm.vptree import nearest

K, EVERY, FACTOR = 5, 50, 1.6


@query("op2_vptree")
def op2_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found, by cosine."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.where(F.col("vec_id") % EVERY == 0), K, FACTOR)
