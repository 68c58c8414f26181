"""Classifiers from tables of signs, by hand."""

import math

from lodestone.operators import classify

CLASSES = [("CS", 1), ("EE", 2), ("ME", 3)]


def frames(spark, texts, terms):
    return spark.createDataFrame(texts, "id long, text string, contents string"), spark.createDataFrame(CLASSES, "class string, place int"), spark.createDataFrame(terms, "class string, term string")


def test_subjects(spark):
    texts = [(1, "About XX and EE101, CS", None), (2, "A Tree and a graph", "hash"), (3, "motors", "Tree"), (4, "nothing", ""), (5, None, None), (None, "tree", ""), (6, "tree motor", None)]
    terms = [("CS", "tree"), ("CS", "Graph"), ("CS", "hash"), ("CS", "tree"), ("EE", "motor"), ("EE", "coil"), ("ME", "")]
    got = {r["id"]: tuple(r)[1:] for r in classify.subjects(*frames(spark, texts, terms), r"\b[A-Z]{2}\b").collect()}
    assert got[1] == ("CS", 0.99, False, None)  # XX is no class; EE101 is no code
    assert got[2] == ("CS", 0.98, False, None) and got[3] == ("EE", 0.75, True, "CS") and got[6] == ("EE", 0.75, True, "CS")
    assert got[4] == (None, 0.0, True, None) and got[5] == (None, 0.0, True, None) and None not in got


def test_votes(spark):
    texts = [(1, "a hash table, trees", None), (2, "tree motor", None), (3, "motors", None), (4, None, None)]
    terms = [("EE", "motor"), ("CS", "tree"), ("CS", "hash table")]
    got = {r["id"]: tuple(r)[1:] for r in classify.voted(*frames(spark, texts, terms), "ME").collect()}
    assert got == {1: ("CS", 2), 2: ("CS", 1), 3: ("ME", 0), 4: ("ME", 0)}


def test_materials(spark):
    texts = spark.createDataFrame([(1, "Lecture_3.pdf", "slide one, next slide"), (2, "x", "an outline and a slide"), (3, None, None)], "id long, name string, text string")
    signs = spark.createDataFrame([("CS", "lecture", 0.5, True), ("EE", "slide", 0.12, False), ("ME", "outline", 0.1, False), ("ME", "an ", 0.1, False)], "class string, term string, weight double, in_name boolean")
    got = {r["id"]: tuple(r)[1:] for r in classify.materials(texts, spark.createDataFrame(CLASSES, "class string, place int"), signs).collect()}
    assert got == {1: ("CS", 0.806), 2: ("ME", 0.625), 3: ("unknown", 0.0)}


def test_kinds(spark):
    texts = spark.createDataFrame([(1, "Notes.txt", "a | b\n1. x"), (2, None, None)], "id long, name string, text string")
    rows = classify.kinds(texts, {"table": [r"\|", r"\t"], "list": [r"(?m)^\d\."], "notes": ["zzz"]}, {"notes": ["note"], "list": ["notes"]}).collect()
    got = {(r["id"], r["kind"]): r["p"] for r in rows}
    raised = {"table": math.exp(0.5 - 1), "list": 1.0, "notes": math.exp(0.1 - 1)}
    assert all(abs(got[1, k] - v / sum(raised.values())) < 1e-12 for k, v in raised.items()) and abs(got[2, "list"] - 1 / 3) < 1e-12
