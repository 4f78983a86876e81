"""op5: benchmark windows in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm.decontamination import benchmark_hits
from filmloom.llm.registry import query, table

WINDOW = 10

#: The same by plain strings: every window of the items against every stretch of as many words.
OP5_SQL = r"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
stretches AS (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
met AS (SELECT r, id, s.k, i FROM stretches s JOIN windows USING (k, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM met) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""


@query("op5_decontamination", OP5_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = benchmark_hits(docs, table(spark, sf_dir, "benchmark"), WINDOW)
    return m.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
