"""Approximate nearest neighbours: a forest of random-projection trees, searched through one
priority queue, then exact reranking of the leaves found.

Each tree splits a bounded sample (``max_sample`` vectors) by hyperplanes between two random points,
at the median, down to ``leaf_size`` sample vectors. Every row of the table is then routed to its
leaf in each tree. A query goes down all trees at once: a heap shared by the forest holds the
branches not taken, ordered by their distance from the splitting plane, and gives up leaves until
enough of them are found. Vectors of those leaves are compared exactly, in double precision.

How many leaves are enough is measured on the table itself: the exact neighbours of ``measured`` of
its queries are found by comparing all vectors, and as many leaves are opened as reach the share
``recall`` of them, ``probes`` at least.

Equal vectors are one class, represented once in the index with its ``k + 1`` smallest ids: no other
member can be among the k nearest of any query. So a vector that a third of all rows share neither
fills a leaf nor multiplies candidates. Leaves are dealt to tasks in buckets.

Vectors that are null, zero, of another than the commonest length, or that hold null or non-finite
components take no part; nor do rows with null vec_id. Repeated rows are one row; of different
vectors under one vec_id the least (compared component by component) stays. Ties go to the smaller
vec_id. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.llm.common import map_arrow, pa_schema, shared_dir, stored


@dataclass
class Tree:
    """Inner node i: normals[i], offsets[i], children[i]; a child below 0 is the leaf ~child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.normals) else np.full(len(x), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            side = (np.einsum("ij,ij->i", x[open_], self.normals[node]) > self.offsets[node]).astype(np.int64)
            at[open_] = self.children[node, side]
        return ~at


def grow(x: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    normals, offsets, children, leaves = [], [], [], 0

    def split(ids: np.ndarray) -> int:
        nonlocal leaves
        if len(ids) > leaf_size:
            for _ in range(4):
                a, b = x[rng.choice(ids, 2, replace=False)]
                normal = a - b
                if (size := np.linalg.norm(normal)) > 0:
                    normal /= size
                    along = x[ids] @ normal
                    offset = np.median(along)
                    right = along > offset
                    if 0 < right.sum() < len(ids):
                        node = len(normals)
                        normals.append(normal)
                        offsets.append(offset)
                        children.append([0, 0])
                        children[node] = [split(ids[~right]), split(ids[right])]
                        return node
        leaves += 1
        return ~(leaves - 1)

    split(np.arange(len(x)))
    dim = x.shape[1]
    return Tree(np.array(normals).reshape(-1, dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def probe(forest: list[Tree], starts: np.ndarray, q: np.ndarray, probes: int) -> list[int]:
    """Numbers, over the forest, of the leaves nearest to q by the shared queue."""
    margins = [t.normals @ q - t.offsets if len(t.normals) else None for t in forest]
    heap = [(-np.inf, i, 0 if len(t.normals) else -1) for i, t in enumerate(forest)]
    heapq.heapify(heap)
    out: list[int] = []
    while heap and len(out) < probes:
        far, i, node = heapq.heappop(heap)
        while node >= 0:
            m = margins[i][node]
            side = int(m > 0)
            heapq.heappush(heap, (max(far, abs(m)), i, int(forest[i].children[node, 1 - side])))
            node = int(forest[i].children[node, side])
        out.append(int(starts[i]) + ~node)
    return out


def margins_needed(tree: Tree, q: np.ndarray) -> np.ndarray:
    """For each query (row of q) and leaf: the greatest margin of a plane to cross on the way, by
    which the queue orders leaves; -inf where none is crossed."""
    if not len(tree.normals):
        return np.full((len(q), 1), -np.inf)
    m = q @ tree.normals.T - tree.offsets
    far, out = np.full(m.shape, -np.inf), np.empty((len(q), tree.leaves))
    for node in range(m.shape[1]):  # parents come before their children
        for side in (0, 1):
            crossed = (m[:, node] > 0) != side
            key = np.where(crossed, np.maximum(far[:, node], np.abs(m[:, node])), far[:, node])
            child = tree.children[node, side]
            if child >= 0:
                far[:, child] = key
            else:
                out[:, ~child] = key
    return out


def probes_for(forest: list[Tree], q: np.ndarray, neighbours: list[np.ndarray], recall: float) -> int:
    """Leaves to open so that this share of the given neighbours of each query is in one of them."""
    keys = [margins_needed(t, q) for t in forest]
    merged = np.sort(np.concatenate(keys, 1), 1)
    need = []
    for i, near in enumerate(neighbours):
        if len(near):
            key = np.min([keys[j][i, t.route(near)] for j, t in enumerate(forest)], 0)
            need.append(np.searchsorted(merged[i], key, "right"))
    need = np.sort(np.concatenate(need)) if need else np.zeros(1, np.int64)
    return int(need[min(len(need), math.ceil(recall * len(need))) - 1])


def exact(classes: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """Vectors of the k nearest other classes of each query, by comparing all; one row for each
    query and neighbour leaves a task."""
    schema = pa_schema("query int, cls long, score double, v array<double>")
    shared = classes.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches):
        q_ids, q = shared.value
        ids, d, x = np.empty((len(q), 0), np.int64), np.empty((len(q), 0)), np.empty((len(q), 0, q.shape[1]))
        for batch in batches:
            if batch.num_rows:
                v, cls = _matrix(batch), np.asarray(batch.column("cls"))
                score = (q**2).sum(1)[:, None] - 2 * (q @ v.T) + (v**2).sum(1)
                score[q_ids[:, None] == cls] = np.inf
                best = np.argsort(score, 1)[:, :k]
                ids = np.concatenate([ids, cls[best]], 1)
                d = np.concatenate([d, np.take_along_axis(score, best, 1)], 1)
                x = np.concatenate([x, v[best]], 1)
                best = np.argsort(d, 1)[:, :k]
                ids, d = np.take_along_axis(ids, best, 1), np.take_along_axis(d, best, 1)
                x = np.take_along_axis(x, best[:, :, None], 1)
        at, rank = np.nonzero(np.isfinite(d))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ids[at, rank]), pa.array(d[at, rank]), pa.array(list(x[at, rank]), schema.field("v").type)], schema=schema)

    least = Window.partitionBy("query").orderBy("score", "cls")
    found = classes.select("cls", "v").mapInArrow(run, "query int, cls long, score double, v array<double>")
    found = found.withColumn("at", F.row_number().over(least)).where(F.col("at") <= k).select("query", "v").toArrow()
    at, x = np.asarray(found.column("query")), _matrix(found) if found.num_rows else np.empty((0, q.shape[1]))
    return [x[at == i] for i in range(len(q))]


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>): the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(good)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["dim"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def search(df: DataFrame, k: int = 10, every: int = 100, trees: int = 12, leaf_size: int = 48, probes: int = 64, max_sample: int = 60_000, bucket_rows: int = 20_000, seed: int = 11, recall: float = 0.95, measured: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by
    ``every``, nearest first."""
    spark = df.sparkSession
    base = shared_dir(spark)
    rows = vectors(df)
    rows = rows.withColumn("c1", F.xxhash64(F.lit(1), "v")).withColumn("c2", F.xxhash64(F.lit(2), "v"))
    rows = stored(rows, base, "vectors")
    least = Window.partitionBy("c1", "c2").orderBy("vec_id")
    members = rows.select("c1", "c2", "vec_id").withColumn("at", F.row_number().over(least)).where(F.col("at") <= k + 1)
    members = members.groupBy("c1", "c2").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    members = members.withColumn("cls", F.col("members")[0])
    classes = stored(members.join(rows.select(F.col("vec_id").alias("cls"), "v"), "cls").select("cls", "c1", "c2", "members", "v"), base, "classes")
    n = classes.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, 1.2 * max_sample / n)
    drawn = classes.where((F.pmod(F.xxhash64(F.lit(5), "cls"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).limit(max_sample).select("v", "cls").orderBy("cls").toArrow()
    flat = drawn.column("v").combine_chunks()
    x = np.asarray(flat.flatten()).reshape(len(flat), -1)
    rng = np.random.default_rng(seed)
    forest = [grow(x, leaf_size, rng) for _ in range(trees)]
    starts = np.concatenate([[0], np.cumsum([t.leaves for t in forest])])
    buckets = int(min(starts[-1], max(1, n * trees // bucket_rows + 1)))
    shared = spark.sparkContext.broadcast((forest, starts))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "c1", "c2")
    asking = asked.join(classes.select("c1", "c2", "cls"), ["c1", "c2"]).select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query_cls"))
    points = classes.join(asking.select(F.col("query_cls").alias("cls")).distinct(), "cls", "left_semi").select("cls", "v")
    some = points.orderBy(F.xxhash64(F.lit(7), "cls"), "cls").limit(measured).toArrow()
    if some.num_rows:
        q = _matrix(some)
        probes = max(probes, probes_for(forest, q, exact(classes, np.asarray(some.column("cls")), q, k), recall))

    def index(batch):
        forest, starts = shared.value
        v = batch.column("v")
        x = np.asarray(v.flatten()).reshape(len(v), -1)
        leaf = np.stack([starts[i] + t.route(x) for i, t in enumerate(forest)], 1).ravel()
        back = np.repeat(np.arange(len(x)), len(forest))
        return {"bucket": leaf % buckets, "leaf": leaf, "cls": batch.column("cls").take(pa.array(back)), "v": v.take(pa.array(back))}

    def aim(batch):
        forest, starts = shared.value
        x = _matrix(batch)
        back, bucket, leaves = [], [], []
        for at, q in enumerate(x):
            found = np.sort(probe(forest, starts, q, probes))
            of = found % buckets
            for b in np.unique(of):
                back.append(at)
                bucket.append(b)
                leaves.append(found[of == b])
        take = pa.array(back, pa.int64())
        return {"bucket": bucket, "leaves": leaves, "cls": batch.column("cls").take(take), "v": batch.column("v").take(take)}

    placed = "bucket long, leaf long, cls long, v array<double>"
    out_schema = pa_schema("query_cls long, cls long, score double", spark)

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, cs, ds = [], [], []
        if left.num_rows and right.num_rows:
            leaves, ids, v = np.asarray(left.column("leaf")), np.asarray(left.column("cls")), _matrix(left)
            order = np.argsort(leaves, kind="stable")
            leaves, ids, v = leaves[order], ids[order], v[order]
            for asked_leaves, q_id, q in zip(right.column("leaves").to_pylist(), np.asarray(right.column("cls")), _matrix(right), strict=True):
                lo, hi = np.searchsorted(leaves, asked_leaves), np.searchsorted(leaves, asked_leaves, "right")
                if at := [np.arange(a, b) for a, b in zip(lo, hi, strict=True) if a < b]:
                    at = np.concatenate(at)
                    d = v[at] - q
                    d = np.sqrt(np.einsum("ij,ij->i", d, d))
                    # A class is in one leaf of each tree: so many entries hold k + 1 classes.
                    most = min(len(d), (k + 1) * trees)
                    few = d <= np.partition(d, most - 1)[most - 1]
                    at, d = at[few], d[few]
                    order = np.lexsort((ids[at], d))
                    first = np.sort(np.unique(ids[at][order], return_index=True)[1])[: k + 1]
                    qs.append(np.full(len(first), q_id))
                    cs.append(ids[at][order][first])
                    ds.append(d[order][first])
        cat = lambda z, t: np.concatenate(z) if z else np.empty(0, t)
        return pa.Table.from_arrays([pa.array(cat(qs, np.int64)), pa.array(cat(cs, np.int64)), pa.array(cat(ds, np.float64))], schema=out_schema)

    placed_rows = map_arrow(classes.select("cls", "v"), placed, index)
    probes_rows = map_arrow(points, "bucket long, leaves array<long>, cls long, v array<double>", aim)
    near = placed_rows.groupBy("bucket").cogroup(probes_rows.groupBy("bucket")).applyInArrow(rerank, "query_cls long, cls long, score double")
    near = near.groupBy("query_cls", "cls").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_cls").orderBy("score", "cls")
    near = near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).join(classes.select("cls", "members"), "cls")
    pairs = near.select("query_cls", "score", F.explode("members").alias("vec_id"))
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = asking.join(pairs, "query_cls").where("query_id <> vec_id").withColumn("rank", F.row_number().over(top).cast("int")).where(F.col("rank") <= k)
    return pairs.select("query_id", "rank", "vec_id", "score")


def _matrix(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    v = t.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten()).reshape(len(v), -1)
