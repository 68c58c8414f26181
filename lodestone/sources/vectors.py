"""A stored vector index: an inverted file of cells, appended to without being built anew, searched by partition.

Below its path: centroids (fitted once, on at most 2 * SAMPLE vectors of the first table), vectors (one folder a cell, every vector of every table),
cells (for each append the number of each cell's vectors and the smallest cosine to its centroid). Vectors are compared by cosine.

A search with `probes` reads the cells whose centroids are nearest a query: approximate. Without, it is exact: a query first searches its home
cell; a cell whose centroid lies at angle a and whose members lie within angle r of it holds nothing nearer than a - r, so the others are
read only where that can beat the k-th best found. Small cells are joined and large ones split into groups of at most BLOCK vectors. A task holds
the vectors of one group, and the queries sent to it pass by, a few at a time; it passes on k rows a query. A query is sent to a group once,
with the cells that it asks for. Folders of cells that no query asks for are not read.

Defined results: vectors that are null, zero, of another width than most of the first table, or hold null or non-finite components take no part, nor do
rows with a null vec_id; a null label is -1; a query never finds rows of its own vec_id; ties go to the smaller vec_id; similarities are rounded to 5 places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, staged

SAMPLE, OF_CELL, MAX_CELLS, ROUNDS = 20_000, 256, 4096, 8
#: Vectors of a group at most and, where that leaves fewer than GROUPS of them, at least.
BLOCK, LEAST, GROUPS = 16384, 1024, 32
#: Elements of a matrix, and bytes of what is passed on, that a task holds at once.
ELEMENTS, BYTES = 1 << 20, 1 << 25
#: Cosines are rounded, so ties at the last place have to be looked at too.
SLACK = 2e-5
FOUND = "q_id long, q_label long, vec_id long, label long, sim double"


def common_width(df: DataFrame) -> tuple[int, int]:
    """The length that most vectors have (of several the smallest), and how many have it."""
    first = df.where("embedding is not null").groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return (first["width"], first["count"]) if first else (0, 0)


def usable(df: DataFrame, width: int) -> DataFrame:
    """vec_id, label, e of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    used = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"), e.alias("e"))
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return used.where(F.col("vec_id").isNotNull() & (F.size("e") == width) & F.coalesce(whole, F.lit(False)) & F.exists("e", lambda x: x != 0))


def _unit(column, width: int) -> np.ndarray:
    """Vectors of length one; scaled first, so that squares neither overflow nor vanish."""
    x = np.array(column.tolist(), np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _few(n: int, columns: int, size: int = 8) -> list[tuple[int, int]]:
    """Runs of n rows, so that a matrix of a run's rows and the columns has at most ELEMENTS, and at most BYTES of rows of this size."""
    step = max(1, min(ELEMENTS // max(1, columns), BYTES // (max(1, columns) * size)))
    return [(i, min(n, i + step)) for i in range(0, n, step)]


def fit(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        at = np.concatenate([(vectors[i:j] @ centroids.T).argmax(axis=1) for i, j in _few(len(vectors), cells)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centroids)
    return centroids


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MAX_CELLS at most
    return np.array([r["e"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["e"]) if rows else 0)


def build(df: DataFrame, path: str) -> None:
    """A new index of df (vec_id, label, embedding). It keeps its centroids whatever is appended."""
    spark = df.sparkSession
    width, n = common_width(df)
    rows = usable(df, width)
    every = max(1, n // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("e").limit(2 * SAMPLE).toPandas()["e"]
    points = _unit(sample, len(sample.iloc[0])) if len(sample) else np.zeros((0, 0))
    points = points[np.lexsort(points.T)] if len(points) else points
    centroids = fit(points, min(len(points), MAX_CELLS, max(1, n // OF_CELL))) if len(points) else np.zeros((0, 0))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, e array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _add(rows, path, centroids)


def append(df: DataFrame, path: str) -> None:
    """Add df's vectors to their cells."""
    centroids = _centroids(df.sparkSession, path)
    _add(usable(df, centroids.shape[1]), path, centroids)


def _add(rows: DataFrame, path: str, centroids: np.ndarray) -> None:
    width = centroids.shape[1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j in _few(len(b), len(centroids)):
                some = b.iloc[i:j]
                sims = _unit(some["e"], width) @ centroids.T
                at = sims.argmax(axis=1)
                yield some.assign(cosine=sims[np.arange(len(some)), at], cell=at.astype("int32"))

    schema = "vec_id long, label long, e array<double>, cosine double, cell int"
    made = staged(rows.mapInPandas(place, schema) if len(centroids) else rows.sparkSession.createDataFrame([], schema), "placed")
    # the bounds come first: if the vectors then don't, the bounds are only wider than they need be
    made.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).coalesce(1).write.mode("append").parquet(f"{path}/cells")
    # the rows of a cell are written by as many tasks as they need, not by all
    sizes = {r["cell"]: r["count"] for r in made.groupBy("cell").count().collect()}  # MAX_CELLS rows at most
    dealt = made.repartition("cell", F.pmod(F.xxhash64("vec_id"), _of({c: -(-n // (4 * BLOCK)) for c, n in sizes.items()}))) if sizes else made
    dealt.write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")
    discard(made)


def _of(values: dict[int, int]) -> Column:
    """The value of each row's cell."""
    return F.element_at(F.array(*[F.lit(values.get(c, 1)) for c in range(max(values) + 1)]), F.col("cell") + 1)


def _bounds(spark: SparkSession, path: str) -> pd.DataFrame:
    return spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least")).toPandas()  # MAX_CELLS rows at most


def _groups(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Of each cell, the first of the groups that its vectors are in and the number of them: one for all but large cells, whose groups are theirs alone."""
    most = min(BLOCK, max(LEAST, sum(sizes.values()) // GROUPS))
    made, last, filled = {}, -1, most
    for cell, n in sorted(sizes.items()):
        if n > most:
            made[cell] = (last + 1, -(-n // most))
            last, filled = last + made[cell][1], most
            continue
        if filled + n > most:
            last, filled = last + 1, 0
        made[cell], filled = (last, 1), filled + n
    return made


def search(queries: DataFrame, path: str, k: int, probes: int | None = None, at_least: float | None = None, keep: Callable | None = None) -> DataFrame:
    """q_id, q_label, vec_id, label, sim, rank of each query's k nearest stored vectors, by cosine.

    probes: so many cells a query, else exact. at_least: a threshold of sim. keep(sims, labels, q_labels): which pairs count, of a matrix of
    queries and vectors (labels: a row of them, q_labels: a column).
    """
    spark = queries.sparkSession
    centroids, bounds = _centroids(spark, path), _bounds(spark, path)
    empty = spark.createDataFrame([], f"{FOUND}, rank int")
    if not len(bounds):
        return empty
    width, cells = centroids.shape[1], bounds["cell"].to_numpy()
    least = np.clip(bounds["least"].to_numpy(), -1, 1)
    sizes = {int(c): int(n) for c, n in zip(cells, bounds["n"], strict=True)}
    asked = usable(queries, width).dropDuplicates(["vec_id"])
    first = 1 if probes is None else probes

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j in _few(len(b), len(cells)):
                some = b.iloc[i:j]
                sims = _unit(some["e"], width) @ centroids[cells].T
                order = sims.argmax(axis=1)[:, None] if first == 1 else np.argsort(-sims, axis=1, kind="stable")[:, :first]
                n = order.shape[1]
                yield some.loc[some.index.repeat(n)].assign(cell=cells[order.reshape(-1)].astype("int32"))

    placed = staged(asked.mapInPandas(homes, "vec_id long, label long, e array<double>, cell int"), "asked")
    near = staged(_visit(placed, path, k, width, sizes, at_least, keep), "near")
    if probes is not None:
        return _ranked(near, k)
    kth = near.withColumn("_r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "vec_id"))).where(F.col("_r") == k).select(F.col("q_id").alias("vec_id"), F.col("sim").alias("kth"))
    floor = -2.0 if at_least is None else at_least - SLACK
    groups = _groups(sizes)
    cells = np.array(sorted(groups))
    centres, least = centroids[cells], least[np.argsort(bounds["cell"].to_numpy())]
    group, parts = (np.array([groups[c][i] for c in cells], np.int32) for i in (0, 1))
    several = len(np.unique(group))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, home, kth = _matrix(b.column("e"), width), b.column("cell").to_numpy(), b.column("kth").to_numpy()
            for i, j in ((i + x, min(i + y, j)) for i, j in _few(b.num_rows, len(cells)) for x, y in _few(j - i, several, 8 * width + 64)):
                angle = np.arccos(np.clip(e[i:j] @ centres.T, -1, 1))
                bound = np.cos(np.maximum(0, angle - np.arccos(least)[None, :]))  # no member is nearer than this
                q, c = np.nonzero((bound + SLACK >= np.maximum(kth[i:j], floor)[:, None]) & (cells[None, :] != home[i:j, None]))
                if len(q):
                    begins = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (group[c[1:]] != group[c[:-1]])])
                    lists = pa.ListArray.from_arrays(np.r_[begins, len(q)].astype(np.int32), cells[c].astype(np.int32))
                    rows, at = b.take(pa.array(i + q[begins])), c[begins]
                    yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in ("vec_id", "label", "e", "kth")), lists, pa.array(group[at]), pa.array(parts[at])], ["vec_id", "label", "e", "kth", "cells", "group", "parts"])

    known = placed.join(kth, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
    rest = staged(known.mapInArrow(others, "vec_id long, label long, e array<double>, kth double, cells array<int>, group int, parts int"), "others")
    wanted = [r["cell"] for r in rest.select(F.explode("cells").alias("cell")).distinct().collect()]  # MAX_CELLS rows at most
    return _ranked(near.union(_meet(rest, wanted, path, k, width, sizes, at_least, keep)) if wanted else near, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("sim"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _visit(asked: DataFrame, path: str, k: int, width: int, sizes: dict[int, int], at_least: float | None, keep: Callable | None) -> DataFrame:
    """Each query (vec_id, label, e) with all vectors of the cell it is sent to; k rows a query and group. sizes: vectors of each cell."""
    wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MAX_CELLS rows at most
    if not wanted:
        return asked.sparkSession.createDataFrame([], FOUND)
    groups = _groups({c: sizes.get(c, 1) for c in {*sizes, *wanted}})
    first, parts = (_of({c: g[i] for c, g in groups.items()}) for i in (0, 1))
    sent = asked.select("vec_id", "label", "e", F.lit(-2.0).alias("kth"), F.array("cell").alias("cells"), first.alias("group"), parts.alias("parts"))
    return _meet(sent, wanted, path, k, width, {c: sizes.get(c, 1) for c in {*sizes, *wanted}}, at_least, keep)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one; scaled first, so that squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _top(sims: np.ndarray, use: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row among those in use, of equal ones the first columns."""
    n = sims.shape[1]
    if n > k:
        full = np.flatnonzero(use.sum(axis=1) > k)
        if len(full):
            some = np.where(use[full], sims[full], -np.inf)
            use[full] &= some >= np.partition(some, n - k, axis=1)[:, n - k, None]
    r, c = np.nonzero(use)
    order = np.lexsort((c, -sims[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _meet(asked: DataFrame, wanted: list[int], path: str, k: int, width: int, sizes: dict[int, int], at_least: float | None, keep: Callable | None) -> DataFrame:
    """Each query (vec_id, label, e, kth, cells, group, parts) with the vectors of its cells in its group and the parts - 1 that follow, from a similarity of kth on."""
    spark = asked.sparkSession
    groups = _groups(sizes)
    first, parts = (_of({c: g[i] for c, g in groups.items()}) for i in (0, 1))
    stored = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(sorted(wanted)))  # other folders aren't read
    there = stored.select((first + F.pmod(F.xxhash64("vec_id"), parts)).cast("int").alias("group"), F.lit(0).alias("kind"), "vec_id", "label", "e", F.lit(0.0).alias("kth"), F.array(F.col("cell").cast("int")).alias("cells"))
    here = asked.select(F.explode(F.sequence("group", F.col("group") + F.col("parts") - 1)).alias("group"), F.lit(1).alias("kind"), "vec_id", "label", "e", "kth", "cells")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), max(g + m for g, m in groups.values()))
    both = there.union(here).repartition(n, "group").sortWithinPartitions("group", "kind", "vec_id")
    names = ["q_id", "q_label", "vec_id", "label", "sim"]

    def compared(x: dict, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q, q_id, q_label, kth = _matrix(b.column("e"), width), *(b.column(c).to_numpy() for c in ("vec_id", "label", "kth"))
        lists = b.column("cells")
        of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        at = np.searchsorted(x["cells"], asks := lists.flatten().to_numpy())
        there = x["cells"][np.minimum(at, len(x["cells"]) - 1)] == asks
        need = np.zeros((b.num_rows, len(x["cells"])), bool)
        need[of[there], at[there]] = True
        for i, j in _few(b.num_rows, len(x["e"])):
            sims = np.round(q[i:j] @ x["e"].T, 5)
            use = need[i:j][:, x["place"]] & (sims >= (kth[i:j] if at_least is None else np.maximum(kth[i:j], at_least))[:, None]) & (x["vec_id"][None, :] != q_id[i:j, None])
            if keep is not None:
                use &= keep(sims, x["label"][None, :], q_label[i:j, None])
            r, c = _top(sims, use, k)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (q_id[i:j][r], q_label[i:j][r], x["vec_id"][c], x["label"][c], sims[r, c])], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, x = None, [], {}
        for whole in batches:
            group, kind = whole.column("group").to_numpy(), whole.column("kind").to_numpy()
            begins = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])]) if len(group) else []
            for i, j in zip(begins, [*begins[1:], len(group)], strict=True):
                b = whole.slice(i, j - i)
                if group[i] != now:
                    now, held, x = group[i], [], {}
                if kind[i] == 0:
                    held.append((_matrix(b.column("e"), width), b.column("vec_id").to_numpy(), b.column("label").to_numpy(), b.column("cells").flatten().to_numpy()))
                    continue
                if held and not x:
                    x = dict(zip(("e", "vec_id", "label", "cell"), (np.concatenate(v) for v in zip(*held, strict=True)), strict=True))
                    x["cells"], x["place"] = np.unique(x.pop("cell"), return_inverse=True)
                    held = []
                if x:
                    yield from compared(x, b)

    return both.mapInArrow(meet, FOUND)
