"""Ball k-means against Lloyd's rounds written out, and awkward vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodestone.llm import balls

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x string, block string"


def brute(rows, k=8, rounds=10, width=64):
    """Rows (id, components): Python integers, every vector with every centroid."""
    kept = [(i, [math.floor(1024 * v) for v in e]) for i, e in rows if e is not None and len(e) == width and all(v is not None and math.isfinite(v) for v in e)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cs = [list(x) for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        for j in range(len(cs)):
            mine = [x for (_, x), a in zip(kept, at, strict=True) if a == j]
            if mine:
                cs[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    last = [(i, *nearest(x)) for i, x in kept]
    total = sum(d for _, d, _ in last)
    return sorted(((i is not None, i or 0), j, d, sum(e for _, e, c in last if c == j), total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in last)


def vectors(n, width=64, seed=5, spread=0.02):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1 / 8) for _ in range(width)] for _ in range(6)]
    rows = [(i, [float(np.float32(v + r.gauss(0, spread))) for v in centres[i % 6]]) for i in range(n)]
    rows += [(n + i, list(rows[i][1])) for i in range(n // 8)]  # copies and so ties
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.1] * 63 + [None]), (905, [0.1] * 63 + [float("nan")]), (906, [0.1] * 63 + [float("inf")])]
    return rows + [(907, [0.0] * 64), (None, [0.25] * 64), rows[3], (3, [-0.5] * 64)]


def run(spark, rows, **kw):
    made = balls.cluster(spark.createDataFrame([(i, e, 1, "c", "x", "b") for i, e in rows], SCHEMA), **kw)
    return sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in made.collect())


@pytest.mark.parametrize("block", [7, 4096])
def test_like_every_vector_with_every_centroid(spark, monkeypatch, block):
    monkeypatch.setattr(balls, "BLOCK", block)
    rows = vectors(160)
    assert run(spark, rows) == brute(rows)


def test_few_vectors_equal_vectors_and_none(spark):
    for rows in ([(5, [0.1] * 64), (6, [0.2] * 64)], [(i, [0.5] * 64) for i in range(20)]):
        assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(ValueError, match="would not fit"):
        run(spark, [(1, [1e9] * 64), (2, [0.0] * 64)])


def test_only_relevant_neighbours_are_compared():
    r = np.random.default_rng(1)
    centroids = r.integers(-400, 400, (12, 64)).astype(np.int64)
    x = np.concatenate([c + r.integers(-9, 9, (300, 64)) for c in centroids]).astype(np.int32)
    before, d, counted = balls.assign(x, None, centroids, np.ones(12, bool))
    assert counted == 12 * len(x)
    moved = centroids + r.integers(-3, 3, centroids.shape)
    at, d, counted = balls.assign(x, before, moved, np.ones(12, bool))
    want = np.array([balls.squares(x, c) for c in moved])
    assert (at == want.argmin(axis=0)).all() and (d == want.min(axis=0)).all()
    assert counted < 1.2 * len(x)  # stable cores meet their own centroid only
    again = balls.assign(x, at, moved, np.zeros(12, bool))
    assert (again[0] == at).all() and again[2] == len(x)


def test_ties_on_the_border_go_to_the_smaller_number():
    centroids = np.array([[0] * 4, [4, 0, 0, 0], [-4, 0, 0, 0]], np.int64)
    x = np.array([[2, 0, 0, 0], [-2, 0, 0, 0], [2, 5, 0, 0]], np.int32)
    at, d, _ = balls.assign(x, np.array([1, 2, 1]), centroids, np.ones(3, bool))
    assert at.tolist() == [0, 0, 0] and d.tolist() == [4, 4, 29]
