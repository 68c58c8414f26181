"""Documents made ready, by hand."""

from pyspark.sql import functions as F

from lodestone.operators import cleaners


def prepared(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    return {r["id"]: r for r in cleaners.preprocess(df, "id", "body").collect()}


def test_all_passes(spark):
    many = " ".join(["word"] * 32)
    text = "\n".join([
        "My Book Header", "1", "Page 3 of 9", "intro words " + many, "my book header", "-----", "Chapter one is about trees ...... 12", "1.2.3 Graph Theory Basics 17", "5.1", "https://x.y/z",
        "2.1 Hashing and Tables", "hash    words " + many, "MY BOOK HEADER ", "MODULE 5", "", "", "", "Published by us", "SHORT CAPITALS", "too few words", "Last Section of All", " ".join(["end"] * 20),
    ])
    got = prepared(spark, text)[0]
    assert list(got["headers"]) == ["My Book Header", "1", "Page 3 of 9", "my book header", "-----", "https://x.y/z", "MY BOOK HEADER", "Published by us"]
    assert list(got["contents"]) == ["Chapter one is about trees ...... 12", "1.2.3 Graph Theory Basics 17"]
    assert [tuple(s) for s in got["sections"]] == [("Introduction", "intro words " + many), ("Hashing and Tables", "hash words " + many), ("Last Section of All", " ".join(["end"] * 20))]
    assert got["text"].startswith("intro words") and "SHORT" not in got["text"] and got["confidence"] == round(1 - 10 / 22 * 0.5, 2)


def test_short_texts_stay_whole(spark):
    got = prepared(spark, "A Title Of Something\nfew words only", None, "", "x\r\ny\x0cz\n")
    assert got[0]["text"] == "A Title Of Something\nfew words only" and [s["title"] for s in got[0]["sections"]] == ["Document"]
    assert got[1]["text"] == "" == got[2]["text"] and got[1]["confidence"] == 0.98 and [tuple(s) for s in got[2]["sections"]] == [("Document", "")]
    assert got[3]["text"] == "x\ny\nz"


def test_single_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert list(one(cleaners.repeated_lines(F.array(*map(F.lit, ["ab c", "AB C ", "x", " ab c", "1234", "1234", "1234", "x", "x"]))))) == ["ab c"]
    assert list(one(cleaners.titled(F.array(*map(F.lit, ["3.2", "UNIT 4 – Sorting things", "unit 4", "7 up", "", "a plain line"]))))) == ["Sorting things", "", "a plain line"]
    assert [one(cleaners.is_title(F.lit(x))) for x in ("Binary Search Trees", "BINARY TREES", "Binary Search.", "binary search trees", "Tree", "A Title With Far Too Many Words In It Here")] == [True, True, False, False, False, False]
