"""Approximate nearest neighbours by cosine: vantage-point trees in shards that a top vantage-point tree deals out.

Vectors of length one have cosine 1 - d^2 / 2 at Euclidean distance d, so the nearest by cosine are the nearest by
distance and the triangle inequality holds. The top tree is grown over a sample of at most ``SAMPLE`` vectors a length;
its leaves are cells. Every vector goes to the cell on its side of all vantage points, and a cell is cut by hash into
shards of about ``shard_rows`` vectors, each with a tree of its own: a node holds a vantage point and the median distance
from it, a leaf a block of vectors.

A query first searches the shards of its own cell. The distance of the k-th found is its reach. Then it visits those
cells alone that have a vector within reach by the triangle inequality: the cell's vectors are between a least and a
largest distance from the cell's centre. In a tree the nearer side goes first, and the other side is skipped where its
distance bound exceeds the reach. Both bounds are relaxed by ``factor``: a part is skipped where ``factor`` times its
bound exceeds the reach. Factor one is the triangle inequality itself, and the search exact; a larger one prunes more.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filmloom.llm._shared import forget, written

#: Vectors of one length that the top tree is grown over, and its cells, at most; more vectors make more shards a cell. Queries of a shard that one task searches.
SAMPLE, CELLS, QUERIES = 32_768, 4096, 100_000


class Tree:
    """Arrays of one shard's tree. ``x`` are the original vectors in double precision, in leaf order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int, seed: int = 7):
        norm = np.linalg.norm(x, axis=1)
        unit = x / norm[:, None]
        rng = np.random.default_rng(seed)
        order: list[np.ndarray] = []
        self.kids: list[tuple[int, int]] = []
        self.radius: list[float] = []
        vantage: list[np.ndarray] = []
        todo = [(np.arange(len(ids)), -1, 0)]
        place = 0
        while todo:
            own, parent, side = todo.pop()
            me = len(self.kids)
            if parent >= 0:
                a, b = self.kids[parent]
                self.kids[parent] = (me, b) if side == 0 else (a, me)
            v = unit[own[rng.integers(len(own))]] if len(own) else np.zeros(x.shape[1])
            d = np.linalg.norm(unit[own] - v, axis=1) if len(own) > leaf else np.zeros(0)
            mid = float(np.median(d)) if len(d) else 0.0
            inner = d <= mid
            if not len(d) or inner.all():
                self.kids.append((-1 - place, len(own)))
                self.radius.append(0.0)
                vantage.append(v)
                order.append(own)
                place += len(own)
                continue
            self.kids.append((0, 0))
            self.radius.append(mid)
            vantage.append(v)
            todo.append((own[~inner], me, 1))
            todo.append((own[inner], me, 0))
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.x, self.norm, self.vantage = ids[at], x[at], norm[at], np.array(vantage)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x.astype(np.float32) if np.array_equal(self.x.astype(np.float32), self.x) else self.x, v=self.vantage, r=np.array(self.radius), k=np.array(self.kids, np.int64))
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> Tree:
        z = np.load(io.BytesIO(blob))
        t = Tree.__new__(Tree)
        t.ids, t.x, t.vantage, t.radius = z["ids"], z["x"].astype(np.float64), z["v"], z["r"].tolist()
        t.kids = [tuple(k) for k in z["k"].tolist()]
        t.norm = np.linalg.norm(t.x, axis=1)
        return t

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``k`` nearest found to every query but itself, nearest first; missing ones are -inf.

        ``within``: the distances that the queries reach already.
        """
        n = len(q)
        qn = np.linalg.norm(q, axis=1)
        unit = q / qn[:, None]
        score = np.full((n, k), -np.inf)
        found = np.full((n, k), np.iinfo(np.int64).max)
        known = np.full(n, np.inf) if within is None else within
        reach = known.copy()

        def leaf(start: int, size: int, who: np.ndarray) -> None:
            for b in range(start, start + size, 4096):
                e = min(b + 4096, start + size)
                s = np.einsum("ij,kj->ik", q[who], self.x[b:e]) / (qn[who][:, None] * self.norm[b:e][None, :])
                ids = np.broadcast_to(self.ids[b:e], s.shape)
                s = np.where(ids == qid[who][:, None], -np.inf, s)
                s = np.concatenate([score[who], s], axis=1)
                ids = np.concatenate([found[who], ids], axis=1)
                best = np.lexsort((ids, -s), axis=1)[:, :k] if s.shape[1] <= 256 else _best(s, ids, k)
                score[who] = np.take_along_axis(s, best, 1)
                found[who] = np.take_along_axis(ids, best, 1)
            reach[who] = np.minimum(known[who], reach_of(score[who, k - 1]))

        def visit(node: int, who: np.ndarray) -> None:
            a, b = self.kids[node]
            if a < 0:
                leaf(-1 - a, b, who)
                return
            gap = np.linalg.norm(unit[who] - self.vantage[node], axis=1) - self.radius[node]
            near = gap <= 0
            for kid, other, side in ((a, b, near), (b, a, ~near)):
                if side.any():
                    mine = who[side]
                    visit(kid, mine)
                    over = factor * np.abs(gap[side]) <= reach[mine]
                    if over.any():
                        visit(other, mine[over])

        if len(self.ids) and n:
            visit(0, np.arange(n))
        return found, score


def reach_of(score: np.ndarray) -> np.ndarray:
    """The distance that belongs to a cosine, a little more for rounding; infinite where there is none."""
    return np.where(np.isneginf(score), np.inf, np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(score, -1.0))) + 1e-9)


class Top:
    """The top tree of one vector length: vantage points with their radii, cells at the leaves and a centre for each."""

    def __init__(self, x: np.ndarray, cells: int, seed: int = 5):
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []  # vantage point, radius, nearer and farther child; -1 - c for cell c
        self.centres: list[np.ndarray] = []
        self.grow(unit, max(1, len(x) // max(1, cells)), rng)

    def grow(self, own: np.ndarray, least: int, rng: np.random.Generator) -> int:
        d = np.zeros(0)
        if len(own) > least:
            v = own[rng.integers(len(own))]
            d = np.linalg.norm(own - v, axis=1)
        mid = float(np.median(d)) if len(d) else 0.0
        if not len(d) or (d <= mid).all():
            self.centres.append(own.mean(axis=0))
            return -len(self.centres)
        me = len(self.nodes)
        self.nodes.append((v, mid, 0, 0))
        self.nodes[me] = (v, mid, self.grow(own[d <= mid], least, rng), self.grow(own[d > mid], least, rng))
        return me

    def cell(self, unit: np.ndarray) -> np.ndarray:
        """The cell of every vector of length one."""
        out = np.zeros(len(unit), np.int64)
        todo = [(0, np.arange(len(unit)))] if self.nodes else []
        while todo:
            at, who = todo.pop()
            v, mid, near, far = self.nodes[at]
            inner = np.linalg.norm(unit[who] - v, axis=1) <= mid
            for child, part in ((near, who[inner]), (far, who[~inner])):
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best columns of every row by score, then id; ties at the k-th score are all looked at."""
    edge = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(s), k), np.int64)
    for r in range(len(s)):
        c = np.flatnonzero(s[r] >= edge[r])
        out[r] = c[np.lexsort((ids[r, c], -s[r, c]))[:k]]
    return out


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows whose vector is neither null nor zero and holds only finite numbers."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(~bad & F.exists("v", lambda x: x != 0))
    )


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of equally long lists, each scaled by a power of two to a largest component of 0.5 to 1.

    Such scaling is exact and leaves cosines as they are, and norms of tiny or huge vectors neither vanish nor overflow.
    """
    x = np.array(col.flatten().to_numpy(zero_copy_only=False)).reshape(len(col), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _tops(base: DataFrame, shard_rows: int) -> dict[int, Top]:
    """Per vector length the top tree, from the vectors with the smallest hashes."""
    counts = {r["dim"]: r["count"] for r in base.groupBy("dim").count().collect()}
    out = {}
    for dim, n in sorted(counts.items()):
        t = base.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toArrow()
        out[dim] = Top(_matrix(t["v"].combine_chunks()), min(CELLS, -(-n // shard_rows)))
    return out


def nearest(base: DataFrame, queries: DataFrame, k: int, factor: float, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192, leaf: int = 256) -> DataFrame:
    """For every query its ``k`` nearest vectors found in ``base``, itself excepted: query_id, rank, vec_id, score.

    Vectors that are null, zero or hold null or non-finite components take no part; only vectors of a query's length
    are its candidates. Fewer than ``k`` candidates give as many rows. Equal scores go by the smaller id. Repeated rows
    are one; an id with several vectors is listed once, with the best of its scores, and as a query is searched with
    each. Empty tables give an empty result; only the id and the vector are read. Vectors come in one length or a few:
    each length has a top tree, which is broadcast; lengths of any number are found in the data itself.
    """
    b = usable(base, id_col, vec_col).withColumn("dim", F.size("v"))
    q = usable(queries, id_col, vec_col).withColumn("dim", F.size("v")).distinct()
    tops = _tops(b, shard_rows)
    sent = base.sparkSession.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            dims = t["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in sent.value:
                    continue
                top = sent.value[dim]
                own = t.filter(pa.array(dims == dim))
                x = _matrix(own["v"])
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                cell = top.cell(unit)
                away = np.linalg.norm(unit - np.array(top.centres)[cell], axis=1)
                yield pa.RecordBatch.from_arrays([own["vec_id"], own["v"], own["dim"], pa.array(cell.astype(np.int32)), pa.array(away)], ["vec_id", "v", "dim", "cell", "away"])

    fields = "vec_id bigint, v array<double>, dim int, cell int, away double"
    dealt = b.mapInArrow(deal, fields)
    # a cell is cut by its own rows, so that many vectors in one place are many shards; a row for each cell
    parts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("bigint").alias("parts"))
    parts = base.sparkSession.createDataFrame(parts.toArrow(), "dim int, cell int, parts bigint")
    dealt = dealt.join(F.broadcast(parts), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"))

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, x, away = t["vec_id"].to_numpy(), _matrix(t["v"].chunk(0)), t["away"].to_numpy()
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)])
        return pa.table(
            {"dim": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([key[2].as_py()], pa.int32()), "least": [float(away.min())], "most": [float(away.max())], "tree": pa.array([Tree(ids[new], x[new], leaf).dump()], pa.binary())}
        )

    trees = dealt.select("dim", "cell", "shard", "vec_id", "v", "away").groupBy("dim", "cell", "shard").applyInArrow(grow, "dim int, cell int, shard int, least double, most double, tree binary")
    trees = written(trees, "vptrees")
    # one row per cell, of which there are CELLS at most
    rings = trees.groupBy("dim", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.collect_set("shard").alias("shards")).collect()
    cells: dict[int, list[tuple[int, float, float, list[int]]]] = {}
    for r in rings:
        cells.setdefault(r["dim"], []).append((r["cell"], r["least"], r["most"], sorted(r["shards"])))
    ringed = base.sparkSession.sparkContext.broadcast(cells)

    def route(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """A row for every shard that a query goes to: those of its own cell, or those of the other cells within reach."""
        for t in batches:
            dims = t["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in sent.value:
                    continue
                top, own = sent.value[dim], t.filter(pa.array(dims == dim))
                x = _matrix(own["v"])
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                mine, reach = top.cell(unit), own["reach"].to_numpy()
                for cell, least, most, shards in ringed.value.get(dim, []):
                    away = np.linalg.norm(unit - top.centres[cell], axis=1)
                    gap = np.maximum(0.0, np.maximum(away - most, least - away))
                    who = np.flatnonzero(mine == cell if first else (mine != cell) & (factor * gap <= reach))
                    for s in shards if len(who) else []:
                        part = own.take(pa.array(who))
                        yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], part["dim"], part["reach"], pa.array(np.full(len(who), cell, np.int32)), pa.array(np.full(len(who), s, np.int32))], ["vec_id", "v", "dim", "reach", "cell", "shard"])

    def look(t: pa.Table, asked: pa.Table) -> pa.Table:
        qid, out = np.zeros(0, np.int64), ([], [], [])
        if t.num_rows and asked.num_rows:
            tree, asked = Tree.load(t["tree"][0].as_py()), asked.combine_chunks()
            for at in range(0, asked.num_rows, 512):
                part = asked.slice(at, 512).combine_chunks()
                qid = part["vec_id"].to_numpy()
                found, score = tree.search(qid, _matrix(part["v"].chunk(0)), k, factor, part["reach"].to_numpy())
                keep = ~np.isneginf(score)
                for x, y in zip(out, (np.repeat(qid, keep.sum(1)), found[keep], score[keep]), strict=True):
                    x.append(y)
        a, c, e = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(c.astype(np.int64)), "score": pa.array(e.astype(np.float64))})

    split = q.count() > QUERIES

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        goes = asked.mapInArrow(lambda batches: route(batches, first), "vec_id bigint, v array<double>, dim int, reach double, cell int, shard int")
        on, own = ["dim", "cell", "shard"], trees
        if split:  # a shard that many queries reach is searched by several tasks, each with some of them; a row for each shard
            slices = written(goes.groupBy(*on).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("slices")), "query-slices")
            own = trees.join(slices, on).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
            of = slices.select(*[F.col(c).alias(c) for c in on], F.col("slices").alias("of"))
            goes = goes.join(of, on).withColumn("slice", F.pmod(F.xxhash64("vec_id", "v"), F.col("of")).cast("int")).drop("of")
            on = [*on, "slice"]
        return own.groupBy(*on).cogroup(goes.groupBy(*on)).applyInArrow(look, "query_id bigint, vec_id bigint, score double")

    def best(hits: DataFrame) -> DataFrame:
        one = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return one.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    near = written(searched(q.select("vec_id", "v", "dim", F.lit(float("inf")).alias("reach")), True), "own-cell")
    far = best(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    reach = F.when(F.col("kth").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("kth"))) + 1e-9)
    rest = q.join(far, "vec_id", "left").select("vec_id", "v", "dim", reach.alias("reach"))
    out = written(best(near.union(searched(rest, False))).select("query_id", "rank", "vec_id", "score"), "nearest")
    forget(trees)
    forget(near)
    return out
