"""Page filters, paper assembly and domain gates by hand."""

from pyspark.sql import functions as F

from lodestone.operators import assembly, domain, pages

PAGE = "doc long, page int, class string, heading string, dense boolean"


def filtered(spark, rows, ranges=(), places=(), **kw):
    r = spark.createDataFrame(list(ranges), "doc long, start int, end int, title string")
    p = spark.createDataFrame(list(places), "doc long, printed int, page int")
    out = {}
    for x in pages.kept_pages(spark.createDataFrame(rows, PAGE), r, p, **kw).collect():
        method, kept = out.setdefault(x["doc"], (x["method"], set()))
        if x["kept"]:
            kept.add(x["page"])
    return out


def test_every_document_chooses_for_itself(spark):
    body = lambda doc, n: [(doc, i, "toc" if i == 1 else "body", None, False) for i in range(1, n + 1)]
    rows = body(1, 30) + body(2, 30) + body(3, 30)
    rows += [(4, i, "unknown", None, i % 2 == 0) for i in range(1, 11)] + [(5, i, "front_matter", None, True) for i in range(1, 21)]
    rows += [(6, i, "back_matter" if i > 12 else "body", "Appendix B" if i == 14 else None, False) for i in range(1, 16)] + [(None, 1, "body", None, True), (1, None, "body", None, True), (1, 5, "body", None, False)]
    ranges = [(1, 1, 9, "One"), (1, 15, 18, "Two"), (1, 20, 25, "Appendix A"), (2, 1, 4, "Few"), (3, 1, 12, "No place"), (6, 1, 14, "All")]
    places = [(d, p, p + 2) for d in (1, 2, 6) for p in range(1, 26)] + [(3, 1, 3), (6, 14, 15)]
    got = filtered(spark, rows, ranges, places)
    assert got[1] == ("contents", {*range(3, 12), *range(17, 21)})
    assert got[2] == ("body", set(range(2, 31))) and got[3] == ("body", set(range(2, 31)))  # four pages are too few; an end has no place
    assert got[4] == ("body", {2, 4, 6, 8, 10}) and got[5] == ("middle", set(range(2, 19)))
    assert got[6] == ("contents", set(range(3, 13)))
    assert filtered(spark, rows, ranges, places, keep_appendices=True)[6] == ("contents", {*range(3, 13), 14})
    assert filtered(spark, []) == {}


SLOT, CAND = "paper long, slot int, topic string", "topic string, candidate long, score double, text string"


def test_only_flagged_slots_are_filled_again(spark):
    slots = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "c"), (2, 1, "b"), (2, 2, "b"), (None, 1, "a"), (2, 3, "none"), (1, 1, "a")]
    cands = [("a", 1, 0.9, "explain hash tables"), ("a", 2, 0.8, "explain tables hash"), ("a", 3, 0.7, "draw a tree"), ("b", 4, 0.5, "draw a tree"), ("b", 5, 0.5, "count the nodes"), ("c", 6, 0.1, "explain hash tables"), ("c", 7, None, "last one"), ("a", None, 1.0, "x")]
    made = assembly.assemble(spark.createDataFrame(slots, SLOT), spark.createDataFrame(cands, CAND))
    got = {(r["paper"], r["slot"]): (r["candidate"], r["round"]) for r in made.collect()}
    # of paper 1 slot 2 repeats slot 1 and slot 4 too; slot 2 then takes "draw a tree", which slot 3 has: slot 3 is later, so it goes on to 5
    assert got == {(1, 1): (1, 0), (1, 2): (3, 1), (1, 3): (5, 2), (1, 4): (7, 1), (2, 1): (4, 0), (2, 2): (5, 0), (2, 3): (None, 0)}


def test_rounds_are_bounded_and_rows_stay(spark):
    slots = spark.createDataFrame([(1, i, "a") for i in range(1, 4)], SLOT)
    cands = spark.createDataFrame([("a", i, 1.0 - i / 100, f"text {i}") for i in range(1, 30)], CAND)
    flag = lambda filled: filled.where("slot > 1")
    got = {r["slot"]: (r["candidate"], r["round"]) for r in assembly.assemble(slots, cands, flag, 3).collect()}
    assert got == {1: (1, 0), 2: (8, 3), 3: (9, 3)}
    assert assembly.assemble(slots.limit(0), cands).collect() == []


def test_words_of_papers_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(p, n, f"explain part {n} of {p}", p) for p in range(30) for n in (1, 2)], "paper long, slot int, text string, candidate long").write.parquet(str(tmp_path / "filled"))
    plans, stage = [], assembly.similarity.staged
    monkeypatch.setattr(assembly.similarity, "staged", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or stage(df, name))
    last = assembly.repeated(spark.read.parquet(str(tmp_path / "filled")))._jdf.queryExecution().toString()
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in [*plans, last])


def test_domain_gate(spark):
    text = "id long, subject string, question string, evidence string, concepts array<string>"
    rows = [
        (1, "cs", "Explain the ECU and a BST.", "the engine", ["BST"]), (2, "cs", "A Lathe machine", "nothing here", None), (3, "cs", "a lathe machine", "nothing", []),
        (4, "cs", "Lathe MACHINE", "one machine", []), (5, "cs", "the tcp stack", "x", []), (6, "net", "the tcp stack", "x", []), (7, "cs", "tcpdump", "", []), (8, "cs", None, None, None), (None, "cs", "ECU", "", []),
        (9, "cs", "ECU DTC CAN MAF", "", []),
    ]
    lists = {"phrases": [("lathe machine",), ("Lathe",)], "foreign": [("cs", "TCP")], "permitted": [("net", "lathe")]}
    made = domain.integrity(
        spark.createDataFrame(rows, text), spark.createDataFrame(lists["phrases"], "term string"),
        spark.createDataFrame(lists["foreign"], "subject string, term string"), spark.createDataFrame(lists["permitted"], "subject string, term string"),
    )
    got = {r["id"]: (list(r["unseen"]), r["passed"], r["score"]) for r in made.orderBy(F.col("id")).collect()}
    assert got[1] == (["ecu"], False, 0.75) and got[2] == (["lathe", "lathe machine"], False, 0.5) and got[3] == ([], True, 1.0)
    assert got[4] == (["lathe"], False, 0.75) and got[5] == (["tcp"], False, 0.75) and got[6] == ([], True, 1.0) and got[7] == ([], True, 1.0) and got[8] == ([], True, 1.0)
    assert got[9] == (["can", "dtc", "ecu", "maf"], False, 0.2) and None not in got
