"""Approximate nearest neighbours by stable projections in a kd-tree (the SRS method), for the largest inner product.

Vectors get one more component, so that the largest inner product becomes the smallest distance: sqrt(M^2 - |x|^2)
for a candidate, with M the largest norm, and 0 for a query, which is scaled to norm M. A Gaussian (2-stable)
projection takes them to `dims` dimensions, where the squared distance over the true squared distance follows a
chi-square law. Projected points are indexed by a kd-tree: its top levels (fitted on a bounded sample) deal all
points into cells, a cell's blocks each have a tree of their own. A query visits leaves in the order of their
distance, verifies the points there by the exact product, and stops once the chi-square test holds: a point at the
k-th best distance would be projected so far away only with probability 1 - `confidence`. Queries begin in their own
cell; what they find there bounds the other cells they have to visit.

Equal vectors are one point that carries its k + 1 smallest ids, more than any query can use, so copies cost
nothing and none is lost. Queries with equal vectors are searched once. Cells with many points are dealt into
blocks of bounded size, queries too; a task sees one block of each.

Sample bound: 2 * `SAMPLE` points at most for the splits of the top levels; every point is indexed. Measured recall: README.

Defined results: vectors that are null, zero, hold null or non-finite components, have a null vec_id, or another
length than most take no part; rows equal in vec_id and vector count once; rows of the query's vec_id are its own;
with fewer than k candidates all are returned; ties go to the smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

K, DIMS, CONFIDENCE = 20, 8, 0.98
SAMPLE, CELL, BLOCK, LEAF, MAX_CELLS = 20_000, 4096, 8192, 64, 4096
SEED = 17
FOUND = "q1 long, q2 long, h1 long, h2 long, score double"


def chi_square_quantile(p: float, dims: int) -> float:
    """Where the chi-square distribution function of an even number of degrees of freedom reaches p."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def matrix(values) -> np.ndarray:
    return np.array(values.tolist() if hasattr(values, "tolist") else list(values), np.float64)


def projection(width: int, dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, dims))


def project(x: np.ndarray, radius: float, query: bool, dims: int) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1))
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(radius * radius - norms * norms, 0))
    scaled = x * (radius / norms)[:, None] if query else x
    return np.hstack([scaled, last[:, None]]) @ projection(x.shape[1], dims)


class Tree:
    """kd-tree over points: splits at medians of the widest dimension; leaves in order, with the boxes of their cells."""

    def __init__(self, points: np.ndarray, leaves: int):
        dims, depth = points.shape[1], max(0, (max(1, leaves) - 1).bit_length())
        self.depth = depth
        self.axis = np.zeros(max(1, 1 << depth), np.int64)
        self.value = np.zeros(max(1, 1 << depth))
        groups = {1: np.arange(len(points))}
        low, high = {1: np.full(dims, -np.inf)}, {1: np.full(dims, np.inf)}
        for node in range(1, 1 << depth):
            mine = groups.pop(node)
            p = points[mine]
            axis = int((p.max(axis=0) - p.min(axis=0)).argmax()) if len(p) else 0
            value = float(np.median(p[:, axis])) if len(p) else 0.0
            self.axis[node], self.value[node] = axis, value
            right = p[:, axis] >= value
            for child, keep in ((2 * node, ~right), (2 * node + 1, right)):
                groups[child] = mine[keep]
                low[child], high[child] = low[node].copy(), high[node].copy()
            high[2 * node][axis] = low[2 * node + 1][axis] = value
        first = 1 << depth
        self.members = [groups[first + k] for k in range(first)]
        self.low = np.array([low[first + k] for k in range(first)])
        self.high = np.array([high[first + k] for k in range(first)])

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            axis = self.axis[node]
            node = 2 * node + (points[np.arange(len(points)), axis] >= self.value[node])
        return node - (1 << self.depth)

    def tighten(self, points: np.ndarray) -> None:
        for k, mine in enumerate(self.members):
            if len(mine):
                self.low[k], self.high[k] = points[mine].min(axis=0), points[mine].max(axis=0)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of one projected query to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


def search(tree: Tree, points: np.ndarray, vectors: np.ndarray, query: np.ndarray, projected: np.ndarray, radius: float, k: int, limit: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and products of the k best verified points. bound: a k-th best product already known (or -inf)."""
    norm = math.sqrt(float(query @ query))

    def reach(product: float) -> float:
        # squared distance between the scaled query and a candidate with this product, times the quantile
        return limit * max(0.0, 2 * radius * radius - 2 * (radius / norm) * product)

    far = tree.distances(projected)
    order = np.argsort(far, kind="stable")
    best, at = np.zeros(0), np.zeros(0, np.int64)
    r, step, i = math.inf if bound == -math.inf else reach(bound), 2, 0
    while i < len(order) and far[order[i]] <= r:
        mine = np.concatenate([tree.members[x] for x in order[i : i + step]])
        i, step = i + step, min(16, step * 2)
        gap = points[mine] - projected
        mine = mine[(gap * gap).sum(axis=1) <= r]
        if not len(mine):
            continue
        products = np.einsum("ij,j->i", vectors[mine], query)
        best, at = np.concatenate([best, products]), np.concatenate([at, mine])
        if len(best) > k:
            worst = np.partition(best, len(best) - k)[len(best) - k]
            keep = best >= worst
            best, at = best[keep], at[keep]
            r = min(r, reach(max(worst, bound)))
    return at, best


def _valid(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0)


def nearest(table: DataFrame, is_query: Column, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest rows of table (vec_id, embedding)."""
    spark = table.sparkSession
    base = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("ask")).where(F.col("vec_id").isNotNull() & _valid(F.col("embedding")))
    base = base.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("second"), "embedding"), "width": F.size("embedding")})
    common = base.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    width = common["width"]
    rows = base.where(F.col("width") == width).drop("width")
    # smallest ids of each vector; ranks are limited before the shuffle, so a vector that fills a third of the table is no burden
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = rows.withColumn("_r", rank).where(F.col("_r") <= k + 1).groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    asked = rows.where("ask").select("vec_id", "h1", "h2").distinct()
    points = staged(few, "points")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    stats = points.agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("radius")).first()
    n, radius = stats["n"], stats["radius"] * (1 + 1e-12)

    every = max(1, n // SAMPLE)
    sample = points.where(F.pmod("h1", F.lit(every)) == 0).select("embedding").limit(2 * SAMPLE).toPandas()
    cells = min(MAX_CELLS, max(1, n // CELL))
    top = Tree(project(matrix(sample["embedding"]), radius, False, dims), cells) if len(sample) else Tree(np.zeros((1, dims)), 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=top.cell(project(matrix(b["embedding"]), radius, False, dims)).astype("int32"))

    dealt = staged(points.mapInPandas(deal, "h1 long, h2 long, embedding array<double>, ids array<long>, cell int"), "cells")
    blocks = {r["cell"]: -(-r["count"] // BLOCK) for r in dealt.groupBy("cell").count().collect()}  # at most MAX_CELLS rows
    of_cell = F.element_at(F.array(*[F.lit(blocks.get(c, 1)) for c in range(1 << top.depth)]), F.col("cell") + 1)
    indexed = dealt.select("h1", "h2", "embedding", "cell", F.pmod("h2", of_cell).cast("int").alias("block"))
    limit = chi_square_quantile(confidence, dims)

    queries = asked.select("h1", "h2").distinct().join(points.select("h1", "h2", "embedding"), ["h1", "h2"])

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=top.cell(project(matrix(b["embedding"]), radius, True, dims)).astype("int32"))

    placed = staged(queries.mapInPandas(home, "h1 long, h2 long, embedding array<double>, cell int").withColumn("part", F.pmod("h1", F.lit(1 << 20)).cast("int")), "queries")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    crowd, all_parts = {c: -(-n // BLOCK) for c, n in counts.items()}, max(1, -(-sum(counts.values()) // BLOCK))
    parts = F.element_at(F.array(*[F.lit(crowd.get(c, 1)) for c in range(1 << top.depth)]), F.col("cell") + 1)
    placed = placed.select("h1", "h2", "embedding", F.col("cell").alias("home"), F.pmod("part", parts).cast("int").alias("part"))

    def visit(key, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("q1", "int64"), ("q2", "int64"), ("h1", "int64"), ("h2", "int64"), ("score", "float64"))})
        vectors, asks = matrix(p["embedding"]), matrix(q["embedding"])
        projected, ask_at = project(vectors, radius, False, dims), project(asks, radius, True, dims)
        tree = Tree(projected, -(-len(p) // LEAF))
        tree.tighten(projected)
        h1, h2, out = p["h1"].to_numpy(), p["h2"].to_numpy(), []
        for j, (q1, q2, bound) in enumerate(zip(q["h1"], q["h2"], q["bound"], strict=True)):
            at, products = search(tree, projected, vectors, asks[j], ask_at[j], radius, k + 1, limit, bound)
            out.append(pd.DataFrame({"q1": q1, "q2": q2, "h1": h1[at], "h2": h2[at], "score": products}))
        return pd.concat(out)

    def visits(q: DataFrame) -> DataFrame:
        """q: queries with cell, part and bound. Each goes to all blocks of the cell; a block is sent once a part of the queries."""
        to = q.withColumn("block", F.explode(F.sequence(F.lit(0), of_cell - 1)))
        pairs = to.select("cell", "block", F.col("part").alias("_part")).distinct()
        there = indexed.join(pairs, ["cell", "block"])
        left, right = to.groupBy("cell", "block", "part"), there.groupBy("cell", "block", "_part")
        return left.cogroup(right).applyInPandas(visit, FOUND)

    near = staged(visits(placed.withColumn("cell", F.col("home")).withColumn("bound", F.lit(float("-inf")))), "near")
    worst = near.withColumn("_r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score")))).where(F.col("_r") == k + 1).select("q1", "q2", F.col("score").alias("bound"))
    bounded = placed.join(worst, (placed["h1"] == worst["q1"]) & (placed["h2"] == worst["q2"]), "left").select("h1", "h2", "embedding", "home", "part", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asks = matrix(b["embedding"])
            at, norms = project(asks, radius, True, dims), np.sqrt((asks * asks).sum(axis=1))
            reach = np.where(b["bound"] == -np.inf, np.inf, limit * np.maximum(0, 2 * radius * radius - 2 * radius / norms * b["bound"]))
            for j in range(len(b)):
                cells = np.flatnonzero(top.distances(at[j]) <= reach[j])
                cells = cells[cells != b["home"].iloc[j]]
                if len(cells):
                    yield pd.DataFrame({c: [b[c].iloc[j]] * len(cells) for c in b.columns} | {"cell": cells.astype("int32")})

    rest = bounded.mapInPandas(spread, "h1 long, h2 long, embedding array<double>, home int, part int, bound double, cell int").where(F.col("cell").isin([c for c in blocks]))
    # queries of all homes that visit a cell go there together, in parts of about BLOCK, so points aren't copied home by home
    rest = rest.withColumn("part", F.pmod("h1", F.lit(all_parts)).cast("int"))
    found = near.union(visits(rest))
    ids = points.select("h1", "h2", "ids")
    named = found.join(ids, ["h1", "h2"]).withColumn("low", F.get("ids", 0))
    best = named.withColumn("_r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "low", "h1"))).where(F.col("_r") <= k + 1)
    # at most k + 1 points of at most k + 1 ids each
    listed = best.groupBy("q1", "q2").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id"))))).alias("all"))
    listed = listed.select("q1", "q2", F.slice(F.sort_array("all"), 1, k + 1).alias("all"))
    per = asked.join(listed, (asked["h1"] == listed["q1"]) & (asked["h2"] == listed["q2"])).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("all", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("top"))
    return per.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
