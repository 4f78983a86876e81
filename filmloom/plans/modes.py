"""Queries on coding modes of blocks, and on pictures rendered from blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.operators.pictures import signed
from filmloom.operators.quality import THRESHOLDS
from filmloom.operators.render import blended
from filmloom.operators.split import SPATIAL, split_modes
from filmloom.operators.split import spatial_sources as sources
from filmloom.plans.media import LUMA_BITS
from filmloom.plans.pictures import _V_SQL, YUV, YUV_SQL, _copies_sql, coloured, coloured_pairs
from filmloom.plans.queries import FRAMES_SQL, frames
from filmloom.plans.registry import query

#: Loss level of the modes.
LEVEL = 22


def _family_sql(block: int, family: int) -> str:
    """Accepted copies of a family: (frame_no, k, s, family, total, bits, ord)."""
    rare, column, opcode = (4, 2, 2) if block == 4 else (1, 3, 1)
    t = THRESHOLDS[LEVEL]
    last, moves, bits, seen = 8 - block, "v", f"CASE WHEN ring <= 1 THEN 5 WHEN ring = 2 THEN 6 WHEN ring = 3 THEN 7 ELSE 10 END + {opcode}", ""
    if family == 0:
        moves, bits = "(SELECT 0 AS ord, 0 AS dx, 0 AS dy)", "2"
    elif family == 2:
        moves = "(VALUES " + ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(SPATIAL[block])) + ")"
        moves, bits = f"(SELECT * FROM {moves} AS m(ord, dx, dy))", str(7 + opcode)
        own = "(p.row_no // 4 * 2 + p.x // 4)"
        child = "p.row_no % 4 // 2 * 2 + p.x % 4 // 2" if block == 2 else "0"
        seen = f" AND bool_and({own} < k OR {own} = k AND {child} < s)"
    pair = f"""FROM places b JOIN {moves} v ON b.x + dx BETWEEN 0 AND {last} AND b.y + dy BETWEEN 0 AND {last} JOIN yuv c ON c.x BETWEEN b.x AND b.x + {block - 1} AND c.row_no BETWEEN b.y AND b.y + {block - 1}
 JOIN yuv p ON p.frame_no = c.frame_no - {0 if family == 2 else 1} AND p.x = c.x + dx AND p.row_no = c.row_no + dy WHERE size = {block} AND c.frame_no IN (SELECT frame_no + 1 FROM yuv) GROUP BY c.frame_no, k, s, ord, dx, dy HAVING count(*) = {block * block}{seen}"""
    profile = f"SELECT c.frame_no AS frame_no, k, s, ord, greatest(abs(dx), abs(dy)) AS ring, {_copies_sql(block, pair)}"
    return f"SELECT frame_no, {block} AS size, k, s, {family} AS family, total, {bits} AS bits, ord FROM ({profile}) WHERE most <= {t[1]} AND over_{t[0]} <= {rare} AND u_error <= {t[0]} AND v_error <= {t[0]} AND total <= {t[column]}"


_LB = f"({LUMA_BITS}::BIGINT[])"
_MODES_SQL = f"""WITH {YUV_SQL}, {_V_SQL}, places AS (SELECT 4 AS size, y // 4 * 2 + x // 4 AS k, 0 AS s, x, y FROM (SELECT unnest([0, 4]) AS x), (SELECT unnest([0, 4]) AS y)
 UNION ALL SELECT 2, y // 4 * 2 + x // 4, y % 4 // 2 * 2 + x % 4 // 2, x, y FROM (SELECT unnest([0, 2, 4, 6]) AS x), (SELECT unnest([0, 2, 4, 6]) AS y)),
copies AS ({" UNION ALL ".join(_family_sql(block, family) for block in (4, 2) for family in range(3))}),
best AS (SELECT frame_no, size, k, s, family, total, bits FROM (SELECT *, row_number() OVER (PARTITION BY frame_no, size, k, s, family ORDER BY total, ord) AS rn FROM copies) WHERE rn = 1),
taken AS (SELECT policy, frame_no, size, k, s, family, bits FROM (SELECT *, row_number() OVER (PARTITION BY policy, frame_no, size, k, s ORDER BY CASE WHEN policy = 'lowest' THEN total END, CASE WHEN policy = 'lowest' THEN bits END, family) AS rn
 FROM best, (SELECT unnest(['ordered', 'lowest']) AS policy)) WHERE rn = 1),
px AS (SELECT frame_no, size, k, s, c.x - b.x AS i, c.row_no - b.y AS j, c.y AS luma FROM places b JOIN yuv c ON c.x BETWEEN b.x AND b.x + size - 1 AND c.row_no BETWEEN b.y AND b.y + size - 1),
g AS (SELECT *, lag(luma) OVER (PARTITION BY frame_no, size, k, s, j ORDER BY i) AS l, lag(luma) OVER (PARTITION BY frame_no, size, k, s, i ORDER BY j) AS a FROM px),
data AS (SELECT frame_no, size, k, s, 12 + sum(CASE WHEN l IS NULL AND a IS NULL THEN 0 ELSE {_LB}[((luma - CASE WHEN a IS NULL THEN l WHEN l IS NULL THEN a ELSE (l + a) // 2 END) & 63) + 1] END) AS base, max(luma) FILTER (i = 0 AND j = 0) AS y0, sum(luma) // (size * size) AS mean FROM g GROUP BY frame_no, size, k, s),
each AS (SELECT policy, frame_no, d.size, d.k, d.s, coalesce(family, -1)::BIGINT AS family, coalesce(bits, 0)::BIGINT AS bits, base::BIGINT AS base, y0::BIGINT AS y0, mean::BIGINT AS mean FROM data d CROSS JOIN (SELECT unnest(['ordered', 'lowest']) AS policy) LEFT JOIN taken USING (policy, frame_no, size, k, s) WHERE frame_no IN (SELECT frame_no + 1 FROM yuv)),
children AS (SELECT policy, frame_no, k, list({{'family': family, 'bits': bits, 'base': base, 'y0': y0, 'mean': mean}} ORDER BY s) AS subs FROM each WHERE size = 2 GROUP BY ALL),
blocks AS (SELECT e.*, subs FROM each e JOIN children USING (policy, frame_no, k) WHERE size = 4)"""
_SUB = f"CASE WHEN c{{i}}.family < 0 THEN c{{i}}.base + {_LB}[((c{{i}}.y0 - p{{i}}) & 63) + 1] ELSE c{{i}}.bits END"
_WALK_SQL = f"""{_MODES_SQL.replace("WITH ", "WITH RECURSIVE ", 1)},
walk AS (SELECT policy, frame_no, -1::BIGINT AS k, 0::BIGINT AS p, ''::VARCHAR AS mode, ''::VARCHAR AS children, 0::BIGINT AS bits FROM blocks WHERE k = 0
UNION ALL SELECT policy, frame_no, k, CASE WHEN family >= 0 THEN p0 WHEN split < own THEN p4 ELSE mean END,
 CASE WHEN family >= 0 THEN (['stationary', 'temporal', 'spatial'])[family + 1] WHEN split < own THEN 'split' ELSE 'data' END,
 CASE WHEN family < 0 AND split < own THEN array_to_string(list_transform(subs, lambda t: (['d', 's', 't', 'p'])[t.family + 2]), '') ELSE '' END,
 CASE WHEN family >= 0 THEN bits WHEN split < own THEN split ELSE own END FROM
 (SELECT *, 2 + n0 + n1 + n2 + ({_SUB.format(i=3)}) AS split, CASE WHEN c3.family < 0 THEN c3.mean ELSE p3 END AS p4 FROM
 (SELECT *, {_SUB.format(i=2)} AS n2, CASE WHEN c2.family < 0 THEN c2.mean ELSE p2 END AS p3 FROM
 (SELECT *, {_SUB.format(i=1)} AS n1, CASE WHEN c1.family < 0 THEN c1.mean ELSE p1 END AS p2 FROM
 (SELECT *, {_SUB.format(i=0)} AS n0, CASE WHEN c0.family < 0 THEN c0.mean ELSE p0 END AS p1 FROM
 (SELECT b.*, w.p AS p0, b.base + {_LB}[((b.y0 - w.p) & 63) + 1] AS own, subs[1] AS c0, subs[2] AS c1, subs[3] AS c2, subs[4] AS c3 FROM walk w JOIN blocks b ON b.policy = w.policy AND b.frame_no = w.frame_no AND b.k = w.k + 1))))))"""


@query("split_policy", f"{_WALK_SQL} SELECT frame_no, policy, CAST(k AS BIGINT) AS k, mode, children, CAST(bits AS BIGINT) AS bits FROM walk WHERE k >= 0")
def split_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per 4x4 block and policy: copied, data, or split into four, whichever has fewer bits where no copy is accepted."""
    return split_modes(coloured_pairs(spark, sf_dir), YUV, LEVEL, LUMA_BITS)


_CELLS = ["stationary4x4", "temporal4x4", "spatial4x4", "data4x4", "split4x4", "stationary2x2", "temporal2x2", "spatial2x2", "data2x2"]


@query(
    "split_histogram",
    f"""{_WALK_SQL}, cells AS (SELECT policy, mode || '4x4' AS cell FROM walk WHERE k >= 0 UNION ALL SELECT policy, CASE c WHEN 's' THEN 'stationary' WHEN 't' THEN 'temporal' WHEN 'p' THEN 'spatial' ELSE 'data' END || '2x2' FROM (SELECT policy, unnest(string_split(children, '')) AS c FROM walk WHERE children <> '')),
every AS (SELECT policy, cell FROM (SELECT DISTINCT policy FROM walk), (SELECT unnest({_CELLS}) AS cell))
SELECT policy, cell, CAST(count(c.cell) AS BIGINT) AS blocks FROM every LEFT JOIN cells c USING (policy, cell) GROUP BY ALL""",
)
def split_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of either size have each mode, by policy; nine rows each."""
    m = split_policy(spark, sf_dir)
    full = F.create_map(*[F.lit(x) for pair in (("s", "stationary2x2"), ("t", "temporal2x2"), ("p", "spatial2x2"), ("d", "data2x2")) for x in pair])
    cell = F.concat(F.array(F.concat("mode", F.lit("4x4"))), F.transform(F.filter(F.split("children", ""), lambda c: c != ""), lambda c: F.element_at(full, c)))
    counts = m.select("policy", F.explode(cell).alias("cell")).groupBy("policy").agg(*[F.count_if(F.col("cell") == c).alias(c) for c in _CELLS])
    return counts.unpivot("policy", _CELLS, "cell", "blocks")


def _spatial_sql(block: int) -> str:
    moves = ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(SPATIAL[block]))
    own, child = "(p.row_no // 4 * 2 + p.x // 4)", "p.row_no % 4 // 2 * 2 + p.x % 4 // 2" if block == 2 else "0"
    pair = f"""FROM places b JOIN (SELECT * FROM (VALUES {moves}) AS m(ord, dx, dy)) v ON b.x + dx BETWEEN 0 AND {8 - block} AND b.y + dy BETWEEN 0 AND {8 - block} JOIN yuv c ON c.x BETWEEN b.x AND b.x + {block - 1} AND c.row_no BETWEEN b.y AND b.y + {block - 1}
 JOIN yuv p ON p.frame_no = c.frame_no AND p.x = c.x + dx AND p.row_no = c.row_no + dy WHERE size = {block} GROUP BY c.frame_no, k, s, ord HAVING bool_and({own} < k OR {own} = k AND {child} < s)"""
    return f"SELECT c.frame_no AS frame_no, {block} AS size, k, s, ord, {_copies_sql(block, pair)}"


@query(
    "spatial_sources",
    f"""{_MODES_SQL.split("copies AS")[0]} found AS ({" UNION ALL ".join(f"SELECT frame_no, size, k, s, ord, total FROM ({_spatial_sql(b)})" for b in (4, 2))}),
g AS (SELECT frame_no, size, k, s, count(*) AS sources, min(total) AS err, arg_min(ord, total * 8 + ord) AS ord FROM found GROUP BY frame_no, size, k, s)
SELECT f.frame_no, CAST(b.size AS BIGINT) AS size, CAST(b.k AS BIGINT) AS k, CAST(b.s AS BIGINT) AS s, CAST(coalesce(sources, 0) AS BIGINT) AS sources, CAST(ord AS BIGINT) AS ord, err FROM places b CROSS JOIN (SELECT DISTINCT frame_no FROM yuv) f LEFT JOIN g ON g.frame_no = f.frame_no AND g.size = b.size AND g.k = b.k AND g.s = b.s""",
)
def spatial_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per block of both sizes the vectors into the picture itself whose source is coded before, and the best of them."""
    c = coloured(spark, sf_dir).select("frame_no", "y", *[F.transform(p, lambda v: signed(v)).alias(p) for p in ("u", "v")])
    return sources(c, YUV)


#: Blocks a side of a tile in the rendering query; pictures are of eight by eight blocks.
TILE = 4
_LANE_SQL = """b AS (SELECT frame_no, x AS bx, y AS brow, luma * 4 AS g, (luma * 3 % 32) * 4 AS bl, (luma * 7 % 32) * 8 AS r, luma % 5 = 0 AS tex, luma % 4 AS step, (luma * 37 + 11) % 256 AS signs FROM frames),
px AS (SELECT b.*, px, py, bx * 2 + px AS ox, brow * 2 + py AS oy, py * 2 + px AS ph FROM b, (SELECT unnest([0, 1]) AS px), (SELECT unnest([0, 1]) AS py)),
n AS (SELECT p.*, CASE WHEN h.tex OR h.tex IS NULL THEN p.g ELSE h.g END AS hg, CASE WHEN h.tex OR h.tex IS NULL THEN p.bl ELSE h.bl END AS hb, CASE WHEN h.tex OR h.tex IS NULL THEN p.r ELSE h.r END AS hr,
 CASE WHEN v.tex OR v.tex IS NULL THEN p.g ELSE v.g END AS vg, CASE WHEN v.tex OR v.tex IS NULL THEN p.bl ELSE v.bl END AS vb, CASE WHEN v.tex OR v.tex IS NULL THEN p.r ELSE v.r END AS vr,
 CASE WHEN (p.signs >> (2 * ph)) & 1 = 1 THEN 1 WHEN (p.signs >> (2 * ph)) & 2 = 2 THEN -1 ELSE 0 END AS way
 FROM px p LEFT JOIN b h ON h.frame_no = p.frame_no AND h.brow = p.brow AND h.bx = p.bx + 2 * px - 1 LEFT JOIN b v ON v.frame_no = p.frame_no AND v.bx = p.bx AND v.brow = p.brow + 2 * py - 1),
c AS (SELECT frame_no, ox, oy, CASE WHEN ox IN (0, 15) AND oy NOT IN (0, 15) THEN (r // 8) * 2048 + (g // 4) * 32 + bl // 4
 WHEN tex THEN (greatest(0, least(255, r + way * ([8, 16, 40, 80])[step + 1])) // 8) * 2048 + (greatest(0, least(255, g + way * ([8, 16, 40, 80])[step + 1])) // 4) * 32 + greatest(0, least(127, bl + way * ([4, 8, 20, 40])[step + 1])) // 4
 WHEN oy IN (0, 15) THEN ((4 * r + ([24, 0, 8, 16])[ph + 1]) // 32 & 31) * 2048 + ((4 * g + ([0, 12, 8, 4])[ph + 1]) // 16 & 63) * 32 + ((4 * bl + ([0, 12, 8, 4])[ph + 1]) // 16 & 31)
 ELSE ((2 * r + hr + vr + ([24, 0, 8, 16])[ph + 1]) // 32 & 31) * 2048 + ((2 * g + hg + vg + ([0, 12, 8, 4])[ph + 1]) // 16 & 63) * 32 + ((2 * bl + hb + vb + ([0, 12, 8, 4])[ph + 1]) // 16 & 31) END AS c FROM n)"""


@query("blended_blocks", f"WITH {FRAMES_SQL}, {_LANE_SQL} SELECT frame_no, CAST(oy AS BIGINT) AS y, CAST(sum(c) AS BIGINT) AS total, CAST(sum(c * (ox + 1)) AS BIGINT) AS placed FROM c GROUP BY frame_no, oy")
def blended_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures rendered from blocks in tiles, flat ones blended with their neighbours: sums of the pixels of every row."""
    v = F.col("luma")
    lanes = {"green": v * 4, "blue": v * 3 % 32 * 4, "red": v * 7 % 32 * 8, "textured": v % 5 == 0, "step": v % 4, "signs": (v * 37 + 11) % 256}
    b = frames(spark, sf_dir).select("frame_no", F.col("x").alias("bx"), F.col("y").alias("by"), *[c.alias(n) for n, c in lanes.items()])
    p = blended(b, "frame_no", 16, 16, TILE).select("frame_no", "y", "x", F.posexplode("pixels").alias("k", "c"))
    return p.groupBy("frame_no", "y").agg(F.sum("c").alias("total"), F.sum(F.col("c") * (F.col("x") + F.col("k") + 1)).alias("placed"))
