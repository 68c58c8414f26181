import math
import random

import numpy as np
import pytest

from lodestone.llm import nearest, registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(n, seed, width=12, spread=0.4):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((8, width))
    made = [(i, (centres[i % 8] * r.uniform(0.5, 2) + spread * r.standard_normal(width)).astype(np.float32).tolist(), 0) for i in range(n)]
    return made


def awkward(made):
    same = made[7][1]
    extra = [(100_000 + i, same, 0) for i in range(60)]
    extra += [(200_000, None, 0), (200_020, [0.0] * 12, 0), (200_040, [float("nan")] * 12, 0), (200_060, [None] + [1.0] * 11, 0), (None, made[1][1], 0), (200_080, [1.0], 0), (200_100, [float("inf")] * 12, 0)]
    return made + extra + [made[3], made[20]]


def brute(made, k):
    width = 12
    ok = {}
    for i, v, _ in made:
        if i is not None and v and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(np.array(v, np.float32), np.float64)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0].tolist():
        s = np.einsum("ij,j->i", x, ok[q])
        order = sorted(((-round(float(a), 9), int(i)) for a, i in zip(s, ids) if i != q))[:k]
        out[q] = [(i, -a) for a, i in order]
    return out


@pytest.mark.parametrize("n", [400, 9000])
def test_recall_and_order(spark, monkeypatch, n):
    monkeypatch.setattr(nearest, "CELL", 512)
    monkeypatch.setattr(nearest, "BLOCK", 700)
    made = awkward(table(n, n))
    monkeypatch.setattr(registry, "_read", lambda *a: spark.createDataFrame(made, SCHEMA))
    want, got = brute(made, 20), {}
    for r in registry.op3_nearest(spark, "").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(want[q]) + 1))
        assert all((-round(a[2], 9), a[1]) < (-round(b[2], 9), b[1]) for a, b in zip(rows, rows[1:]))
        true = dict(want[q])
        assert all(abs(true[v] - s) < 1e-6 for _, v, s in rows if v in true)
        hits += len({v for _, v, _ in rows} & set(true))
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_few_candidates_are_all_returned(spark):
    made = [(i, [1.0 + i, 2.0, -1.0], 0) for i in range(0, 100, 20)]
    got = nearest.nearest(spark.createDataFrame(made, SCHEMA), nearest.F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 20 and {r.query_id for r in got} == {0, 20, 40, 60, 80}


def test_empty_and_clashing(spark):
    wide = SCHEMA + ", h1 string, ids string, cell string, ask string"
    assert nearest.nearest(spark.createDataFrame([], wide), nearest.F.col("vec_id") % 20 == 0).count() == 0
    made = [(*m, "a", "b", "c", "d") for m in table(100, 1)]
    assert nearest.nearest(spark.createDataFrame(made, wide), nearest.F.col("vec_id") % 20 == 0).count() == 100


def test_quantile():
    assert abs(nearest.chi_square_quantile(0.95, 8) - 15.507) < 0.01


def test_tree_leaves_hold_all_points():
    r = np.random.default_rng(0)
    p = r.standard_normal((1000, 4))
    p[:300] = p[0]
    t = nearest.Tree(p, 16)
    assert sorted(np.concatenate(t.members)) == list(range(1000))
    assert all((t.cell(p[m]) == k).all() for k, m in enumerate(t.members) if len(m))
