"""Packers and parsers against the rules gone through in Python, on random texts and by hand."""

import random
import re

from pyspark.sql import functions as F

from lodestone.operators import packers, questions


def texts(seed, n=60):
    r = random.Random(seed)
    out = ["", None, "  \n\n \n"]
    for _ in range(n):
        paras = []
        for _ in range(r.randint(1, 9)):
            k = r.choice([2, 5, 9, 14, 30])
            sents = [" ".join(r.choice(["tree", "Hash", "x1", "é"]) for _ in range(r.randint(1, 6))) + r.choice([".", "!", "?", ""]) for _ in range(max(1, k // 4))]
            paras.append(r.choice(["", "", "2.1 Trees ", "GRAPHS\n", "Lemma "]) + " ".join(sents))
        out.append(r.choice(["\n\n", "\n\n\n", "\n \n"]).join(paras))
    return out


def packs(paras, least, most, cut=None):
    out, cur, n = [], [], 0
    for p in paras:
        k = len(p.split())
        if k >= least:
            if cur and n >= least:
                out.append("\n".join(cur))
                cur, n = [], 0
            out += cut(p) if cut and k > most else [p]
            continue
        cur.append(p)
        n += k
        if n >= most:
            out.append("\n".join(cur))
            cur, n = [], 0
    return out + (["\n".join(cur)] if cur and n >= least else [])


def halves(p, least, most, rest):
    out, cur, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", p):
        cur.append(s)
        n += len(s.split())
        if least <= n <= most:
            out.append(" ".join(cur))
            cur, n = [], 0
    return out + ([" ".join(cur)] if cur and n >= rest else [])


def modules(text, target, least, most):
    out, cur, n = [], [], 0

    def flush():
        nonlocal cur, n
        if cur and n >= least:
            out.append("\n\n".join(cur))
        cur, n = [], 0

    for p in (p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()):
        k = len(p.split())
        if k > most:
            flush()
            buf, m = [], 0
            for s in re.split(r"(?<=[.!?])\s+", p):
                if m + len(s.split()) > target and buf:
                    if m >= least:
                        out.append(" ".join(buf))
                    buf, m = [s], len(s.split())
                else:
                    buf.append(s)
                    m += len(s.split())
            cur, n = cur + buf, n + m
            continue
        if re.match(packers.HEADING, p) and n > least:
            flush()
        if n + k > target and n > least:
            flush()
        cur.append(p)
        n += k
    flush()
    return out


def test_packers(spark):
    rows = list(enumerate(texts(1)))
    df = spark.createDataFrame(rows, "id long, text string").select(
        "id", packers.paragraph_packs(F.col("text"), 6, 15).alias("a"), packers.concept_packs(F.col("text"), 5, 12, 3).alias("b"), packers.module_packs(F.col("text"), 14, 4, 20).alias("c")
    )
    got = {r["id"]: r for r in df.collect()}
    seen = 0
    for i, t in rows:
        t = t or ""
        plain = lambda at, t=t: [p.strip() for p in re.split(at, t) if p.strip()]
        assert got[i]["a"] == packs(plain(r"\n\n"), 6, 15)
        assert got[i]["b"] == packs(plain(r"\n\n+"), 5, 12, lambda p: halves(p, 5, 12, 3))
        assert got[i]["c"] == modules(t, 14, 4, 20)
        seen += len(got[i]["c"])
    assert seen > 60


def test_a_small_pack_waits_past_a_large_paragraph(spark):
    text = "one two\n\n" + " ".join(["big"] * 80) + "\n\nthree"
    assert spark.range(1).select(packers.paragraph_packs(F.lit(text), 80, 400)).first()[0] == [" ".join(["big"] * 80)]
    assert spark.range(1).select(packers.paragraph_packs(F.lit(text), 3, 400)).first()[0] == [" ".join(["big"] * 80), "one two\nthree"]


def test_module_chunks_are_numbered(spark):
    df = spark.createDataFrame([("m1", "a b c d e\n\nf g h i j"), ("m2", "a")], "module string, text string")
    got = packers.module_chunks(df, "module", "text", target=5, least=3, most=9).collect()
    assert [tuple(r) for r in got] == [("m1", "m1_chunk_01", 1, 2, 5, "a b c d e"), ("m1", "m1_chunk_02", 2, 2, 5, "f g h i j")]


def test_parsers(spark):
    rows = [
        (1, "Q1. Define a hash table. [5]\nAns: it maps keys\nQ2: Why is a tree balanced? (10 marks)", "cs"),
        (2, "Some heading here\n\n1. Explain trees\nwith a figure 5M\n2) too\n(3) Design a queue for jobs", "cs"),
        (3, "Nothing at the start\nDescribe the process of learning\nshort ?", None), (4, "no sign at all in this text", "x"), (5, None, "x"), (6, "", "x"),
    ]
    got = {}
    for r in questions.parse(spark.createDataFrame(rows, "id long, text string, subject string"), "id", "text", "subject").collect():
        got.setdefault(r["id"], []).append((r["place"], r["question"], r["answer"], r["parser"], r["marks"]))
    assert got[1] == [(0, "Define a hash table. [5]", "it maps keys", "by_q", 5), (1, "Why is a tree balanced? (10 marks)", None, "by_q", 10)]
    assert got[2] == [(0, "Some heading here", None, "by_number", None), (1, "Explain trees with a figure 5M", None, "by_number", None), (2, "Design a queue for jobs", None, "by_number", None)]
    # text 3 and 4 are one question each to the second parser, as lines without a number belong together
    assert got[3] == [(0, "Nothing at the start Describe the process of learning short ?", None, "by_number", None)] and got[4][0][3] == "by_number"
    assert 5 not in got and 6 not in got
    one = spark.range(1).select(questions.by_line(F.lit("Nothing at the start\n7) Describe the process\nshort ?")).alias("l"), questions.by_block(F.lit("A block\nof text ?\n\nnothing here at all\n\ndiscuss")).alias("b")).first()
    assert [tuple(q) for q in one["l"]] == [("Describe the process", None, "7) Describe the process")] and [q["question"] for q in one["b"]] == ["A block\nof text ?"]
