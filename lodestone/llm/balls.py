"""Ball k-means on integers: the exact result of Lloyd's rounds, comparing only where a centroid can win.

Components are scaled and floored, so distances, sums and centroids are exact whatever the order of additions.
Vectors lie in blocks of some thousands. In each round a block's members of a cluster are a ball around their new
centroid: its radius is the largest distance among them. By the triangle inequality a centroid at distance D from
the ball's own can't win a member at distance r of it unless 2 r >= D; all with 2 * radius >= D are the ball's
neighbours. Members closer than half the nearest neighbour's distance are the stable core and stay. The others lie
in annuli between the half distances of the neighbours in ascending order: a member of the k-th annulus is compared
exactly with the first k neighbours and with no other. A neighbour that didn't move since the last round, nor the
own centroid, can't win either and is left out. Comparisons are of squares of integers, so ties are exact too.

Blocks are dealt once and kept on disk by partition; a round joins them with the last round's cluster numbers (a byte a
vector) without moving a vector again. Each block gives its clusters' counts and sums; k rows of them reach the driver.

Defined results: a vector that is null, of another width, or with null or non-finite components takes no part; rows
equal in vec_id (or null there) are vectors each; the first centroids are taken by the hash of the id, then by the vector;
with fewer than k vectors there are as many centroids; an empty table gives no row; other columns are ignored. A
component so large (2 ** 26 after scaling, at width 64) that squared distances don't fit a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, staged

K, ROUNDS, SEED, SCALE, WIDTH = 8, 10, 3, 1024, 64
BLOCK = 4096
#: Blocks of one partition: some 64 MB of vectors.
BLOCKS_OF_PARTITION = 64
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept(table: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and x, the scaled integers, of the vectors that take part."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("e").isNotNull() & (F.size("e") == width) & F.coalesce(F.forall("e", finite), F.lit(False)))
    return rows.select("vec_id", F.transform("e", lambda v: F.floor(v * scale)).alias("x"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to one centroid c, as longs."""
    if len(x) and len(c) * (int(np.abs(x).max()) + int(np.abs(c).max())) ** 2 < 1 << 53:  # exact in doubles
        gap = x.astype(np.float64) - c
        return np.einsum("ij,ij->i", gap, gap).astype(np.int64)
    gap = x.astype(np.int64) - c
    return (gap * gap).sum(axis=1)


def assign(x: np.ndarray, own: np.ndarray | None, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), its squared distance, and how many distances were worked out.

    own: the nearest centroids of the last round, moved: which centroids differ from it; without own every centroid is compared.
    """
    n, k = len(x), len(centroids)
    if own is None:
        best, at = squares(x, centroids[0]), np.zeros(n, np.int64)
        for j in range(1, k):
            d = squares(x, centroids[j])
            wins = d < best
            best[wins], at[wins] = d[wins], j
        return at, best, n * k
    at, best, counted = own.astype(np.int64), np.zeros(n, np.int64), 0
    for j in np.unique(own):
        mine = np.flatnonzero(own == j)
        ball = x[mine]
        r = squares(ball, centroids[j])
        apart = squares(centroids, centroids[j])
        near = np.array([i for i in np.argsort(apart, kind="stable") if i != j and apart[i] <= 4 * int(r.max()) and (moved[i] or moved[j])], np.int64)
        counted += len(mine)
        annulus = np.searchsorted(apart[near], 4 * r, side="right")  # neighbours that can win the member; none: the stable core
        low, where = r.copy(), np.full(len(mine), j, np.int64)
        for t, i in enumerate(near):
            ring = np.flatnonzero(annulus > t)
            if not len(ring):
                break
            d = squares(ball[ring], centroids[i])
            counted += len(ring)
            wins = (d < low[ring]) | ((d == low[ring]) & (i < where[ring]))
            low[ring[wins]], where[ring[wins]] = d[wins], i
        at[mine], best[mine] = where, low
    return at, best, counted


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows of up to BLOCK vectors: block, ids and x as 32-bit integers."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([part + n], pa.int64()), ids, pa.array([x.tobytes()], pa.binary())], names=["block", "ids", "x"])
                n += 1

    return rows.mapInArrow(run, "block long, ids array<long>, x binary")


STATE = "block long, own binary, compared long, sums array<struct<c: int, n: long, s: array<long>>>"


def _round(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Every block's clusters (one number a vector), and its counts and sums by cluster."""
    width, kind, begun = centroids.shape[1], "u1" if len(centroids) <= 256 else "<i4", state is not None
    rows = blocks.select("block", "x") if state is None else blocks.select("block", "x").join(state.select("block", "own").hint("shuffle_hash"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i, data in enumerate(b.column(1)):
                x = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, width)
                own = np.frombuffer(b.column(2)[i].as_buffer(), kind) if begun else None
                at, _, counted = assign(x, own, centroids, moved)
                sums = [{"c": int(c), "n": int((at == c).sum()), "s": x[at == c].sum(axis=0, dtype=np.int64).tolist()} for c in np.unique(at)]
                made.append({"block": b.column(0)[i].as_py(), "own": at.astype(kind).tobytes(), "compared": counted, "sums": sums})
            yield pa.RecordBatch.from_pylist(made, schema=_state_schema())

    return rows.mapInArrow(run, STATE)


def _state_schema() -> pa.Schema:
    sums = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))
    return pa.schema([("block", pa.int64()), ("own", pa.binary()), ("compared", pa.int64()), ("sums", sums)])


def _updated(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; a cluster without vectors keeps its centroid. k rows come to the driver."""
    width = centroids.shape[1]
    parts = state.select(F.explode("sums").alias("p")).select("p.c", "p.n", "p.s")
    totals = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(width)]).alias("s"))
    made = centroids.copy()
    for r in totals.collect():
        made[r["c"]] = [int(v) // r["n"] for v in r["s"]]
    return made


def _assigned(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    width, kind, begun = centroids.shape[1], "u1" if len(centroids) <= 256 else "<i4", state is not None
    rows = blocks.select("x", "ids") if state is None else blocks.join(state.select("block", "own").hint("shuffle_hash"), "block").select("x", "ids", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(0)):
                x = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, width)
                own = np.frombuffer(b.column(2)[i].as_buffer(), kind) if begun else None
                at, d, _ = assign(x, own, centroids, moved)
                yield pa.RecordBatch.from_arrays([b.column(1)[i].values, pa.array(at.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(rows: DataFrame, k: int, by: Column) -> np.ndarray:
    return np.array([r["x"] for r in rows.orderBy(by, "x").limit(k).select("x").collect()], np.int64)


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of table (vec_id, embedding) that takes part."""
    spark = table.sparkSession
    rows = kept(table, width, scale)
    found = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))).alias("most")).first()
    if not found["n"]:
        return spark.createDataFrame([], RESULT)
    if 16 * width * int(found["most"]) ** 2 >= 1 << 63 or found["most"] >= 1 << 31:
        raise ValueError(f"a component of {found['most']} after scaling: squared distances would not fit a long")
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = first_centroids(rows, k, by)
    moved = np.ones(len(centroids), bool)
    # written first, so that a block lost with an executor is read again as it was
    packed = staged(_blocks(rows, width), "vectors")
    parts = max(partitions(spark), -(-found["n"] // (BLOCK * BLOCKS_OF_PARTITION)))
    blocks = packed.repartition(parts, "block").persist(StorageLevel.DISK_ONLY)
    try:
        state = None
        for _ in range(rounds):
            last, state = state, staged(_round(blocks, state, centroids, moved), "clusters")
            if last is not None:
                discard(spark, last)
            new = _updated(state, centroids)
            centroids, moved = new, (new != centroids).any(axis=1)
            if not moved.any():
                break  # every further round would give the same
        made = staged(_assigned(blocks, state, centroids, moved), "assigned")
    finally:
        blocks.unpersist()
    discard(spark, packed)
    if state is not None:
        discard(spark, state)
    inertia = {r["cluster"]: r["s"] for r in made.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total, text = sum(inertia.values()), [",".join(map(str, c)) for c in centroids.tolist()]
    named = spark.createDataFrame([(c, int(s), int(total), text[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, t string")
    each = F.broadcast(named.select("cluster", "cluster_inertia", "inertia", F.sha2("t", 256).alias("centroid_sha256")))  # k rows
    return made.join(each, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
