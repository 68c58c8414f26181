"""Pairs of rows that share a key, from blocks."""

from lodestone.operators import pairing
from lodestone.plans import paper_queries


def test_pairs_come_once(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK", 4)
    wanted = [(i, "Bolt") for i in range(30)] + [(1, "nut"), (1, "NUT"), (2, "screw"), (40, None), (None, "bolt"), (3, "bolt")]
    named = [(i, "bolt") for i in range(20, 45)] + [(1, "nut"), (20, "NUT"), (21, "Screw"), (21, "nut"), (50, "screw"), (None, "nut")]
    frame = lambda rows, text: spark.createDataFrame(rows, f"id long, {text} string")
    made = pairing.resolved(frame(wanted, "needs"), frame(named, "name"))
    got = [(r.src, r.dst) for r in made.collect()]
    want = {(a, b) for a, x in wanted for b, y in named if None not in (a, b, x, y) and x.lower() == y.lower() and a != b}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_are_not_compared_one_by_one(spark):
    rows = spark.range(2000).selectExpr("id", "'same' as needs", "'same' as name")
    assert pairing.resolved(rows, rows).count() == 2000 * 1999
    assert paper_queries.QUERIES["name_resolution"].__module__ == paper_queries.__name__  # not the SQL, whose DISTINCT holds every pair
