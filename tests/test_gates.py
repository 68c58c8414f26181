"""Gates and packers on small hand-made rows, and packers against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import gates as G
from lodestone.operators import segment


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, "empty"), ("   ", "empty"), ("Explain this now.", "short"), ("Explain the working principle of the", "dangling"),
        ("Explain the (first part] of it.", "unbalanced"), ("Explain the working of a pump", "punctuation"),
        ("Pumps and valves are nice things.", "structure"), ("Explain the working [of (a) pump].", "complete"), ('Explain the "odd quote of it.', "unbalanced"),
    ],
)
def test_completeness(spark, text, want):
    assert one(spark, text, G.completeness) == want


def test_grammar(spark):
    assert one(spark, None, G.grammar_issues) == ["empty_text"]
    assert one(spark, "sure hey okay", G.grammar_issues) == ["capitalization", "punctuation", "slang_detected", "slang_detected", "conversational_intro", "too_short"]
    assert one(spark, "Explain the working of a pump.", G.grammar_gate) == 1.0
    assert abs(one(spark, "here is **it**", G.grammar_gate) - (1 - 0.4 - 0.15 - 0.2 - 0.3 - 0.1)) < 1e-9


def test_grounding(spark):
    rows = [("What is entropy in 42 systems?", "Entropy of systems", "a"), ("Is it so?", "Nothing", "b"), ("Entropy?", None, "c")]
    got = {r["k"]: r["g"] for r in spark.createDataFrame(rows, "q string, e string, k string").select("k", G.grounding(F.col("q"), F.col("e")).alias("g")).collect()}
    assert got["b"]["coverage"] == 0.75 and got["c"]["coverage"] == 0.70
    assert got["a"]["passed"] and abs(got["a"]["coverage"] - max(0.40, 2 / 3 - 0.15)) < 1e-9


def brute(text, size, modules):
    sentences = re.split(r"(?<=[.!?])\s+", text)
    out, now, n = [], [], 0
    goal = max(1, len(text.split()) // modules) if modules else None
    for s in sentences:
        w = len(s.split())
        if goal is None and n + w > size and now:
            out.append(now)
            now, n = [], 0
        now.append(s)
        n += w
        if goal is not None and n >= goal and len(out) < modules - 1:
            out.append(now)
            now, n = [], 0
    return [" ".join(x) for x in (out + [now] if now else out)]


@pytest.mark.parametrize("modules", [None, 3])
def test_sentence_packs(spark, modules):
    texts = [None, "", " \n", "One.", "A b c. " * 30, "word " * 500, "x y! z? " * 7 + "tail", "One two three four five six. Seven."]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, pack string")
    got = {}
    for r in sorted(segment.sentence_packs(df, "doc_id", "text", 10, modules).collect(), key=lambda r: r["pack_no"]):
        got.setdefault(r["doc_id"], []).append(r["pack"])
        assert r["words"] == len(r["pack"].split())
    assert got == {i: brute(t, 10, modules) for i, t in enumerate(texts) if t and t.strip()}


def test_paragraph_groups(spark):
    p = [f"paragraph number {i} with some more words" for i in range(7)]
    df = spark.createDataFrame([(1, "\n\n".join([*p, "short"])), (2, p[0]), (3, None)], "doc_id long, text string")
    got = {r["segment"]: r["paragraphs"] for r in segment.paragraph_groups(df, "doc_id", "text", 3).collect()}
    assert got == {0: p[:2], 1: p[2:4], 2: p[4:]}
