"""Operators over a caller's tables, with rows worked out by hand."""

from lodestone.operators import dialect, papers, texts


def run(spark, text, **tables):
    made = {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in tables.items()}
    return [tuple(r) for r in dialect.apply(spark, text, **made).collect()]


def test_or_parity_lifts_the_shorter_side(spark):
    q = ("paper long, mq int, part int, marks int", [(1, 1, 1, 6), (1, 1, 2, 4), (1, 2, 1, 5), (1, 2, 2, 3), (1, 3, 1, 7)])
    assert sorted(run(spark, papers.OPERATORS["or_parity_enforced"], questions=q)) == [(1, 1, 1, 6), (1, 1, 2, 4), (1, 2, 1, 5), (1, 2, 2, 5), (1, 3, 1, 7)]


def test_audit_takes_the_worst_verdict_and_the_geometric_mean(spark):
    a = ("run long, verdict string, confidence double", [(1, "COMPLIANT", 0.9), (1, "DEGRADED", 0.4), (1, "BYPASSED", 0.0), (2, "VIOLATED", 0.0)])
    got = {r[0]: r[1:] for r in run(spark, papers.OPERATORS["audit_report"], audits=a)}
    assert got == {1: ("BYPASSED", 0.6, 77, True), 2: ("VIOLATED", 1.0, 80, True)}


def test_stages_go_one_by_one(spark):
    s = ("concept long, seq int, understand double, compare double, explain double", [(1, 1, 0.9, 0.9, 0.9), (1, 2, 0.9, 0.9, 0.9), (1, 3, 0.1, 0.6, 0.0), (2, 1, 0.3, 1.0, 1.0), (3, 1, 0.5, 0.0, 0.0)])
    assert {r[0]: r[1] for r in run(spark, papers.OPERATORS["stage_progress"], signals=s)} == {1: "connected", 2: "unseen", 3: "recognised"}


def test_merge_takes_the_definition_of_the_more_reliable(spark):
    c = ("name string, seq int, reliability double, definition string, explanation string, point string, kind string, diagram boolean",
         [("a", 1, 0.5, "first", "xx", "p", "textbook", False), ("a", 2, 0.4, "worse", "xxxx", "q", "notes", True), ("a", 3, 0.9, "", "x", "p", "previous_paper", False), ("a", 4, 0.95, "best", "yyyy", "", "question_bank", False)])
    assert run(spark, papers.OPERATORS["merge_enrich"], candidates=c) == [("a", "best", "xxxx", 2, True, 1, 1, True)]


def test_marked_questions(spark):
    text = "Header\n\n1. Explain the process\nof it all [10 Marks]\nok (5m)\n" + "\n".join(f"line {i}" for i in range(8)) + "\nDefine a thing now 2 marks"
    got = run(spark, texts.OPERATORS["marked_questions"].replace("md5(body)", "body"), docs=("id long, text string", [(1, text), (2, None), (3, "")]))
    # "ok" has too few words; of the eight lines the first seven go
    assert sorted((r[2], r[3]) for r in got) == [(2, "line 7 Define a thing now"), (10, "Explain the process of it all")]


def test_clean_lines_and_keywords(spark):
    text = "Intro-\nduction here\n12\n---\nhttp://x.y\nmain.py\nCopyright 2020\n\nSecond part"
    op = texts.OPERATORS["clean_lines"].replace("md5(regexp_sub", "(regexp_sub")
    assert run(spark, op, docs=("id long, text string", [(1, text)])) == [(1, 9, 5, "Introduction here##Second part")]
    got = run(spark, texts.OPERATORS["keywords"], docs=("id long, text string", [(1, "This Graph has Nodes; the graph and edges2 with nodes colour")]))
    assert got == [(1, "graph,nodes,colour")]


def test_contamination(spark):
    words = "one two three four five six seven"
    got = run(spark, texts.OPERATORS["contamination"], items=("id long, text string", [(1, words)]), docs=("id long, text string", [(7, "x one two three four five six y"), (8, "one two"), (9, None)]))
    assert got == [(1, 7, 0.6667)]
