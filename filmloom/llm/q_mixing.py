"""op3: mixing all documents to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.llm.mixing import mixed, training_order
from filmloom.llm.registry import query, table

#: The same mix in one SQL statement, with plain windows over whole sources; {docs} is the table.
MIX_SQL = r"""
WITH d AS (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rnk FROM s),
w AS (SELECT *, (rnk - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM r),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rnk) AS place, CAST((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
o AS (SELECT arg_min(level, place) FILTER (CAST(cap AS DOUBLE) > level * weight) AS open_level FROM l),
t AS (SELECT source, source_size, rnk, CASE WHEN open_level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), open_level * weight) END AS target FROM l, o),
p AS (SELECT d.*, t.source_size, t.target, t.rnk,
    coalesce(sum(size) OVER (PARTITION BY t.rnk ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(3.0, floor(target / source_size)) AS passes FROM p),
m AS (SELECT *, CASE WHEN size = 0 OR source_size = 0 THEN 0 ELSE CAST(passes + CASE WHEN passes < 3 AND place + size / 2.0 < target - passes * source_size THEN 1 ELSE 0 END AS BIGINT) END AS copies FROM c),
u AS (SELECT *, list_transform(range(copies), lambda i: least(1.0, CAST(place + i * source_size AS DOUBLE) / target)) AS shares FROM m),
t2 AS (SELECT *, list_transform(shares, lambda s: CASE WHEN s >= 1.0 THEN 1.0
    WHEN rnk % 2 = 1 THEN (sqrt(greatest(0.0, CAST(2.25 AS DOUBLE) + CAST(-2.0 AS DOUBLE) * s)) - CAST(1.5 AS DOUBLE)) / CAST(-1.0 AS DOUBLE)
    ELSE (sqrt(greatest(0.0, CAST(0.25 AS DOUBLE) + CAST(2.0 AS DOUBLE) * s)) - CAST(0.5 AS DOUBLE)) / CAST(1.0 AS DOUBLE) END) AS due FROM u)
"""
OP3_SQL = MIX_SQL.format(docs="documents") + """SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(copies * size AS BIGINT) AS taken,
    array_to_string(list_transform(due, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',') AS positions FROM t2"""


@query("op3_mixing", OP3_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, in training order, and positions, when each copy is due, in millionths of the training."""
    m = training_order(mixed(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    positions = F.array_join(F.transform("due", lambda t: F.round(t * 1000000).cast("bigint").cast("string")), ",")
    return m.select("_key.doc_id", "size", "source_size", "target", "taken", positions.alias("positions"))
