"""Set-similarity and containment joins: hand-worked rows, and everything against everything."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import contain, similarity


def sets(spark, rows, group=None):
    df = spark.createDataFrame([(i, None if t is None else t.split()) for i, t in rows], "id long, ws array<string>")
    return similarity.word_sets(df, "id", F.col("ws"), group=group)


def test_best_match_by_hand(spark):
    names = sets(spark, [(1, "binary search tree"), (2, "queue"), (3, "search binary tree"), (4, ""), (5, None), (None, "stack")])
    known = sets(spark, [(5, "the binary search tree"), (6, "search tree"), (7, "stack"), (9, "tree search"), (8, "the search binary tree")])
    # {binary, search, tree} shares 3 of 4 with 5 and 8, and 2 of 3 with 6 and 9
    assert sorted(map(tuple, similarity.best_match(names, known).collect())) == [(1, 5, 0.75), (3, 5, 0.75)]


def test_in_order_a_row_goes_only_by_a_kept_one(spark):
    # 2 goes by 1; 3 would go by 2 alone, so it stays; 4 goes by 3; 5 has the words of 2 and goes as 2 does; empty rows stay
    rows = [(1, "a b c d"), (2, "a b c d e"), (3, "b c d e f g"), (4, "c d e f g"), (5, "e d c b a"), (6, ""), (7, ""), (8, "q"), (9, "q")]
    got = {r["id"]: r["kept"] for r in similarity.keep_in_order(sets(spark, rows)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: True, 8: True, 9: False}


def test_a_chain_takes_rounds(spark):
    # each row holds 4 of the 5 words of the one after it and of no other: kept and dropped take turns
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5)) if i == 0 else " ".join([*(f"w{i - 1}x{k}" for k in range(4)), f"w{i}x0"])) for i in range(2)]
    words = [set(t.split()) for _, t in rows]
    for i in range(2, 12):
        last = sorted(words[-1])
        words.append({*last[1:], f"n{i}"})
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    got = {r["id"]: r["kept"] for r in similarity.keep_in_order(sets(spark, rows)).collect()}
    want, kept = {}, []
    for i, w in enumerate(words):
        want[i] = not any(len(w & k) / len(w) > 0.75 for k in kept)
        if want[i]:
            kept.append(w)
    assert got == want and len(set(want.values())) == 2


@pytest.mark.parametrize(("measure", "per_cent"), [("union", 55), ("union", 80), ("larger", 80), ("left", 75)])
def test_all_pairs(spark, measure, per_cent):
    r = random.Random(per_cent)
    base = [[r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(3)) for _ in range(r.randint(0, 14))] for _ in range(12)]
    rows = [(i, " ".join(w for w in base[i % 12] + [f"x{i}"] * r.randint(0, 2) if r.random() < 0.9) + " of the") for i in range(90)]
    made = {(x["a"], x["b"]): (x["n"], x["m"], x["both"]) for x in similarity.similar(sets(spark, rows), None if measure != "left" else sets(spark, rows), measure, per_cent).collect()}
    want = {}
    for i, s in rows:
        for j, t in rows:
            x, y = set(s.split()), set(t.split())
            both, whole = len(x & y), {"union": len(x | y), "larger": max(len(x), len(y)), "left": len(x)}[measure]
            if (i > j or measure == "left") and (100 * both >= per_cent * whole if measure == "union" else 100 * both > per_cent * whole):
                want[i, j] = (len(x), len(y), both)
    assert made == want and len(want) > 50


def test_common_words_make_no_candidates(spark):
    """Every set has the same twelve words, and eight that no other has: no pair has to be compared."""
    rows = [(i, " ".join([f"common{k}" for k in range(12)] + [f"own{i}x{k}" for k in range(8)])) for i in range(300)]
    ranked = similarity._ranked(sets(spark, rows).select(F.lit(0).alias("side"), "id", "tokens"))
    assert similarity.candidates(ranked, "union", 80, True).count() == 0
    assert similarity.similar(sets(spark, rows)).count() == 0


def test_classes_and_links(spark):
    rows = [(1, "a b c d"), (2, "d c b a"), (3, "a b c d e"), (4, "z"), (5, ""), (6, None)]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in similarity.duplicate_classes(sets(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0), 5: (5, 0), 6: (5, 0)}


TEXTS = [(1, "the hash table"), (2, "a tree"), (3, ""), (4, None), (5, "hashing tables, trees"), (6, "été_a tree")]
PATTERNS = [(1, "hash"), (2, "table"), (3, "tree"), (3, "table"), (4, None), (5, ""), (6, "hash table"), (7, "a"), (8, "tree")]


def frames(spark):
    return (spark.createDataFrame(x, "id long, text string") for x in (TEXTS, PATTERNS))


@pytest.mark.parametrize("chars", [1 << 20, 6])
@pytest.mark.parametrize("whole", [False, True])
def test_matches_like_every_text_with_every_pattern(spark, monkeypatch, chars, whole):
    """With few characters allowed, patterns are dealt into shards and texts into parts."""
    monkeypatch.setattr(contain, "PATTERN_CHARS", chars)
    monkeypatch.setattr(contain, "PART_CHARS", 20)
    import re

    want = set()
    for i, t in TEXTS:
        for p, x in PATTERNS:
            if t is not None and x and (re.search(rf"(?<!\w){re.escape(x)}(?!\w)", t) if whole else x in t):
                want.add((i, p))
    made = contain.matches(*frames(spark), whole_words=whole)
    got = [tuple(r) for r in made.collect()]
    assert set(got) == want and (chars < 20 or len(got) == len(want))
    plan = made._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_first_either_way(spark):
    topics = spark.createDataFrame([(1, "hash tables"), (2, "tree"), (3, "graph"), (4, None)], "id long, text string")
    names = spark.createDataFrame([(7, "binary tree"), (5, "red tree"), (9, "hash"), (3, "zebra")], "id long, text string")
    assert sorted(map(tuple, contain.first_either_way(topics, names).collect())) == [(1, 9), (2, 5), (3, None)]
    empty = names.union(spark.createDataFrame([(8, "")], "id long, text string"))
    assert sorted(map(tuple, contain.first_either_way(topics, empty).collect())) == [(1, 8), (2, 5), (3, 8)]


def test_lookup_passes(spark):
    library = spark.createDataFrame([(1, "tree", 2, 1), (2, "tree", 2, 0), (3, "", 2, 1), (4, "", 2, 0), (5, "graph", 1, 0), (6, "", 3, 0)], "entry long, keyword string, level int, kind int")
    asked = spark.createDataFrame([(1, "A Tree", 2, 0), (2, "a tree", 2, 9), (3, "sets", 2, 1), (4, "sets", 3, 5), (5, "sets", 1, 0), (6, None, 2, 1)], "id long, topic string, level int, kind int")
    assert sorted(map(tuple, contain.lookup(asked, library).collect())) == [(1, 1, 2), (2, 2, 1), (3, 3, 3), (4, 4, 6), (6, 3, 3)]


def test_rules_come_from_a_table(spark):
    texts = spark.createDataFrame([(1, "Use a Binary Tree here", "the engine of a car", None), (2, "binary tree", "car with a binary tree", None), (3, "a binary tree", "cooking", "Car repair"), (4, "tcp", "cooking", ""), (5, "tcpdump", "cars", "")], "id long, question string, evidence string, name string")
    rules = spark.createDataFrame([("auto", False), ("net", True)], "rule string, whole_words boolean")
    terms = spark.createDataFrame([("auto", "trigger", "car"), ("auto", "forbidden", "Binary Tree"), ("net", "forbidden", "tcp")], "rule string, role string, term string")
    got = sorted(map(tuple, contain.rule_violations(texts, rules, terms).collect()))
    assert got == [(1, "auto", "binary tree"), (3, "auto", "binary tree"), (4, "net", "tcp")]


def test_only_sets_that_are_met_are_compared(spark, monkeypatch):
    rows = [(i, " ".join([f"every{j}" for j in range(4)] + [f"w{i}x{j}" for j in range(16)])) for i in range(300)]  # a fifth of each is in all
    rows += [(300 + i, t.replace(f"w{i}x0", "other")) for i, t in rows[:2]]
    seen, stage = {}, similarity.staged
    monkeypatch.setattr(similarity, "staged", lambda df, name: seen.setdefault(name, []).append((made := stage(df, name)).count()) or made)
    pairs = similarity.similar(sets(spark, rows), None, "union", 80)
    assert sorted((r.a, r.b, r.both) for r in pairs.collect()) == [(300, 0, 19), (301, 1, 19)]
    assert seen["met"] == [2] and seen["whole"] == [4]


def test_turns_lose_no_pair(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, " ".join(r.sample([f"w{j}" for j in range(14)], 11))) for i in range(60)]
    words = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a in words for b in words if a > b and len(words[a] & words[b]) * 100 >= 80 * len(words[a] | words[b])}
    for often in (1, 1000):
        monkeypatch.setattr(similarity, "OFTEN", often)
        got = [(x.a, x.b) for x in similarity.similar(sets(spark, rows), None, "union", 80).collect()]
        assert set(got) == want and len(got) == len(want) > 120
