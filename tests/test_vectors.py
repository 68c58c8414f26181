"""Vector search: exact and by probes, appends, pruning; with vectors that can't take part."""

import numpy as np

from lodestone.operators import retrieve
from lodestone.sources import vectors


def test_ragged_and_non_finite_vectors_take_no_part(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.0, 1.0]), (4, 1, [float("nan"), 1.0]), (5, 1, [1.0]), (6, 1, None), (7, 1, [0.0, 0.0]), (8, 1, [float("inf"), 1.0]), (9, 1, [None, 1.0]), (None, 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = retrieve.vector_top(df, df, 2).collect()
    assert {(r.q_id, r.vec_id) for r in got} == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)}


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, label long, embedding array<double>")
    assert retrieve.vector_top(df, df, 2).count() == 0


def table(spark, n, seed, first=0, groups=12):
    r = np.random.default_rng(seed)
    centres = np.random.default_rng(0).standard_normal((groups, 16))
    x = centres[r.integers(0, groups, n)] + r.standard_normal((n, 16)) * 0.25
    return x, spark.createDataFrame([(first + i, int(i % 3), v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, embedding array<double>")


def brute(q, x, q_ids, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(q) @ unit(x).T, 5)
    return {(int(i), int(j)) for i, row in zip(q_ids, sims, strict=True) for j in [c for c in np.lexsort((np.arange(len(x)), -row)) if c != i][:k]}


def test_stored_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "OF_CELL", 64)
    monkeypatch.setattr(vectors, "BLOCK", 100)
    x, df = table(spark, 1500, 1)
    more, added = table(spark, 300, 2, 1500)
    path = str(tmp_path / "index")
    vectors.build(df, path)
    assert len(vectors._centroids(spark, path)) == 23
    q_ids = list(range(0, 1500, 50))
    queries = df.where("vec_id % 50 = 0")
    exact = {(r.q_id, r.vec_id) for r in vectors.search(queries, path, 10).collect()}
    assert exact == brute(x[q_ids], x, q_ids, 10)
    some = {(r.q_id, r.vec_id) for r in vectors.search(queries, path, 10, probes=3).collect()}
    assert len(some & exact) >= 0.9 * len(exact)
    files = sorted((tmp_path / "index" / "vectors").rglob("*.parquet"))
    vectors.append(added, path)
    assert set(files) < set((tmp_path / "index" / "vectors").rglob("*.parquet"))  # nothing was written anew
    both = np.concatenate([x, more])
    assert {(r.q_id, r.vec_id) for r in vectors.search(queries, path, 10).collect()} == brute(both[q_ids], both, q_ids, 10)
    near = vectors.search(added.where("vec_id = 1600"), path, 5, at_least=0.9).collect()
    assert near and all(r.sim >= 0.9 for r in near)


def test_cells_that_nobody_asks_for_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "OF_CELL", 64)
    _, df = table(spark, 1000, 3)
    path = str(tmp_path / "index")
    vectors.build(df, path)
    asked = vectors.usable(df.where("vec_id = 7"), 16).selectExpr("vec_id", "label", "e", "2 as cell")
    made = vectors._visit(asked, path, 3, 16, {c: 1 for c in range(15)}, None, None)
    plan = made._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "= 2)" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hard_negatives_keep_easy_pairs(spark):
    unit = lambda a: [float(np.cos(a)), float(np.sin(a))]
    base = spark.createDataFrame([(1, 0, unit(0)), (2, 0, unit(0.6)), (3, 0, unit(0.7)), (4, 0, unit(2.5)), (5, 0, unit(0.01))], "vec_id long, label long, embedding array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 1), (9, 1), (1, None)], "anchor long, positive long")
    got = {(r["anchor"], r["positive"]): (r["negative"], r["pair_type"]) for r in retrieve.hard_negatives(pairs, base).collect()}
    assert got == {(1, 2): (3, "hard"), (1, 3): (2, "hard"), (4, 1): (None, "easy"), (9, 1): (None, "easy"), (1, None): (2, "hard")}


def test_a_query_is_sent_to_a_group_of_cells_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "OF_CELL", 16)
    x = np.random.default_rng(5).standard_normal((4000, 16))  # without structure: nearly all of 250 cells are read
    x[3000:3040] = x[50]  # ties, more than are asked for
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, embedding array<double>")
    path, sent, stage = str(tmp_path / "index"), {}, vectors.staged
    vectors.build(df, path)
    monkeypatch.setattr(vectors, "staged", lambda df, name: sent.setdefault(name, stage(df, name)))
    monkeypatch.setattr(vectors, "ELEMENTS", 5000)
    got = {(r.q_id, r.vec_id) for r in vectors.search(df.where("vec_id % 50 = 0"), path, 10).collect()}
    assert got == brute(x[::50], x, range(0, 4000, 50), 10)
    assert sent["others"].count() <= 80 * 6
