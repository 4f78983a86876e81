"""op11: ranked lexical search for benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filmloom.llm.lexical import ranked
from filmloom.llm.registry import query, table

TOP = 50

#: The same by joining every document with every item on their terms.
OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT DISTINCT k, t FROM (SELECT k, unnest(w) AS t FROM items)),
sizes AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs),
totals AS (SELECT CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY t), totals),
impacts AS (SELECT r, t, w, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)) AS impact FROM tf JOIN sizes USING (r) JOIN weights USING (t), totals),
scores AS (SELECT k, r, CAST(sum(w * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (t) GROUP BY k, r),
places AS (SELECT k, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN sizes USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM places JOIN items USING (k) WHERE rank <= 50
"""


@query("op11_lexical_search", OP11_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: its 50 best documents as item_id, rank, doc_id, score."""
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), TOP)
