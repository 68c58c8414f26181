"""Retrieval scores by hand, in several blocks of queries, and what a plan must not have."""

import math

import pytest

from lodestone.functions.text import CHUNK_VOCABULARY
from lodestone.operators import search

Q, C = "q_id long, text string, module string", "id long, text string, module string"


def test_grounded_by_hand(spark):
    vocabulary = list(dict.fromkeys(CHUNK_VOCABULARY))[:4]
    rows = [(1, "red graph x9 of it", "m1"), (2, "red graph " + " ".join(vocabulary), "m2"), (3, None, None), (4, " ".join(["plain"] * 100), "m1"), (5, " ".join(["plain"] * 1000), ""), (None, "red graph", "m1")]
    chunks = spark.createDataFrame(rows, C)
    queries = spark.createDataFrame([(1, "Red graph graph, ab x9y", None), (2, "Red graph", "m1"), (3, None, "m1"), (None, "red", "m1")], Q)
    got = {}
    for r in search.grounded(queries, chunks, 5, size=2).collect():
        got.setdefault(r["q_id"], {})[r["id"]] = (round(r["score"], 6), r["rank"])
    hits = lambda t: sum(w in t for w in set(CHUNK_VOCABULARY))
    fixed = {i: 0.3 * min(1, hits(t or "") / 8) + 0.2 * (n / 80 if n < 80 else 1 if n <= 400 else 0.5) for i, t, n in ((1, rows[0][1], 5), (2, rows[1][1], len(rows[1][1].split())), (3, "", 0), (4, rows[3][1], 100), (5, rows[4][1], 1000))}
    both = {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}
    for i in range(1, 6):
        base = math.floor((0.5 * both[i] + fixed[i]) * 1e4 + 0.5 + 1e-6) / 1e4
        assert got[1][i][0] == pytest.approx(base)
        assert got[2][i][0] == pytest.approx(min(1, base + 0.15) if i in (1, 4) else base * 0.6 if i == 2 else base)
    assert got[3][4][1] == 1 and set(got) == {1, 2, 3}
    assert search.grounded(queries.limit(0), chunks).collect() == [] and search.grounded(queries, chunks.limit(0)).collect() == []


def test_dense_and_lexical(spark):
    chunks = spark.createDataFrame([(1, "red", "a", [1.0, 0.0]), (2, "blue", "a", [0.0, 2.0])], C + ", vector array<double>")
    queries = spark.createDataFrame([(1, "red", "b", [0.0, 1.0])], Q + ", vector array<double>")
    got = {r["id"]: r["score"] for r in search.grounded(queries, chunks).collect()}
    # the module doesn't count where there are vectors; one word of 80 is worth 0.0025
    assert got == {1: pytest.approx(0.4 * 0.5025), 2: pytest.approx(0.6 + 0.4 * 0.0025)}


def test_concepts_by_hand(spark):
    known = spark.createDataFrame([(1, "Hash table", "hash table of keys", 0.5, "k"), (2, "Tree", "a tree has nodes", 0.9, "t"), (3, "Empty", None, 0.1, "k")], "id long, name string, text string, confidence double, kind string")
    queries = spark.createDataFrame([(1, "hash hash unseen"), (2, "  "), (3, "tree")], "q_id long, text string")
    got = {}
    for r in search.concepts(queries, known, 2, size=1).collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["id"], r["score"]))
    idf, oov = math.log(4 / 2) + 1, math.log(4)
    q = (2 / 3 * idf, 1 / 3 * oov)
    cosine = (q[0] * idf / 4) / (math.hypot(*q) * math.sqrt(4 * (idf / 4) ** 2))
    assert sorted(got[1]) == [(1, 1, pytest.approx(min(1, 0.7 * cosine + 0.15 + 0.15))), (2, 2, pytest.approx(0.27))]
    assert sorted(got[2]) == [(1, 2, 0.9), (2, 1, 0.5)]
    assert sorted(got[3])[0] == (1, 2, pytest.approx(0.7 * 0.5 + 0.27 + 0.15))
    assert {r["id"] for r in search.concepts(queries, known, 3, kind="k").collect()} == {1, 3}
    plan = search.concepts(queries, known, 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
