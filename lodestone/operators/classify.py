"""What a text is about and what kind of material it is, by tables of signs; texts are scanned once by an automaton, whole.

Defined results: rows with a null id take no part, null texts are empty; of equal scores the class with the smaller place wins; signs count once a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contain

#: Fixed values.
BY_CODE, CAP, STRETCH, SURE, APART = 0.99, 0.98, 1.5, 0.90, 0.10
KNOWN, HINT = 0.30, 0.10


def _low(texts: DataFrame, *columns: str) -> DataFrame:
    return texts.where("id is not null").select("id", F.lower(F.concat_ws("\n", *columns)).alias("text"))


def _met(texts: DataFrame, terms: DataFrame, whole_words: bool = False) -> DataFrame:
    """id and the columns of terms (class, term, ...) for each term in a text, each once."""
    named = terms.withColumn("text", F.lower("term")).where("text <> ''").dropDuplicates(["class", "text"]).withColumn("pattern", F.xxhash64("class", "text"))
    found = contain.matches(texts, named.select(F.col("pattern").alias("id"), "text"), whole_words)
    return found.join(named.drop("text"), "pattern").drop("pattern")


def _order(scored: DataFrame, classes: DataFrame) -> DataFrame:
    """id and its classes from the best on; scored: id, class, score. classes: class, place."""
    item = F.struct((-F.col("score")).alias("s"), "place", "class")
    return scored.join(classes.select("class", "place"), "class").groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("o"))  # a class each


def subjects(texts: DataFrame, classes: DataFrame, terms: DataFrame, code: str) -> DataFrame:
    """id, subject, confidence, confirm, second: the subject whose code (a pattern) stands in the text, else the one with the largest share of its terms.

    texts: id, text, contents. classes: class, place. terms: class, term. confirm: the share is low, or little above the next one's. No sign at all: no subject.
    """
    codes = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(code), F.lit(0))
    listed = texts.where("id is not null").select("id", F.posexplode(codes).alias("p", "class")).join(classes.select("class"), "class", "left_semi")
    by_code = listed.groupBy("id").agg(F.min_by("class", "p").alias("coded"))
    of = terms.where("term <> ''").select("class", F.lower("term").alias("t")).distinct().groupBy("class").agg(F.count("*").alias("of"))
    hits = _met(_low(texts, "text", "contents"), terms).groupBy("id", "class").agg(F.count("*").alias("n"))
    best = _order(hits.join(of, "class").select("id", "class", (F.col("n") / F.col("of")).alias("score")), classes)
    first, after = -F.get("o", F.lit(0))["s"], F.coalesce(-F.get("o", F.lit(1))["s"], F.lit(0.0))
    confidence = F.when(first.isNotNull(), F.least(F.lit(CAP), first * STRETCH))  # least() passes over nulls
    made = texts.where("id is not null").select("id").join(by_code, "id", "left").join(best, "id", "left")
    return made.select(
        "id", F.coalesce("coded", F.get("o", F.lit(0))["class"]).alias("subject"), F.round(F.when(F.col("coded").isNotNull(), BY_CODE).otherwise(F.coalesce(confidence, F.lit(0.0))), 4).alias("confidence"),
        (F.col("coded").isNull() & F.coalesce((confidence < SURE) | (first - after < APART), F.lit(True))).alias("confirm"), F.when(F.col("coded").isNull(), F.get("o", F.lit(1))["class"]).alias("second"),
    )


def voted(texts: DataFrame, classes: DataFrame, terms: DataFrame, default: str) -> DataFrame:
    """id, subject, votes: a phrase in the text counts two for its class, a word that stands alone one; without a vote it is the default."""
    low, phrase = _low(texts, "text"), F.col("term").contains(" ")
    votes = _met(low, terms.where(phrase)).select("id", "class", F.lit(2).alias("v")).union(_met(low, terms.where(~phrase), whole_words=True).select("id", "class", F.lit(1)))
    best = _order(votes.groupBy("id", "class").agg(F.sum("v").alias("score")), classes).select("id", F.get("o", F.lit(0))["class"].alias("c"), (-F.get("o", F.lit(0))["s"]).alias("v"))
    return texts.where("id is not null").select("id").join(best, "id", "left").select("id", F.coalesce("c", F.lit(default)).alias("subject"), F.coalesce("v", F.lit(0)).cast("long").alias("votes"))


def materials(texts: DataFrame, classes: DataFrame, signs: DataFrame) -> DataFrame:
    """id, material, confidence: the class with the largest share of all weights found, `unknown` below KNOWN.

    texts: id, name, text. signs: class, term, weight, in_name (the sign counts in the name alone; others count in name and text).
    """
    name, both = _low(texts, "name"), _low(texts, "name", "text")
    found = _met(name, signs.where("in_name")).select("id", "class", "weight").union(_met(both, signs.where("not in_name")).select("id", "class", "weight"))
    each = found.groupBy("id", "class").agg(F.sum(F.col("weight").cast("decimal(18,6)")).alias("score"))
    total = each.groupBy("id").agg(F.sum("score").alias("all"))
    best = _order(each, classes).join(total, "id").select("id", F.get("o", F.lit(0))["class"].alias("c"), (-F.get("o", F.lit(0))["s"] / F.col("all")).cast("double").alias("share"))
    made = texts.where("id is not null").select("id").join(best, "id", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return made.select("id", F.when(F.col("share") >= KNOWN, F.col("c")).otherwise("unknown").alias("material"), F.round("share", 3).alias("confidence"))


def _softmax(score: Column, by: Column) -> Column:
    return F.exp(score - by)


def kinds(texts: DataFrame, patterns: dict[str, list[str]], hints: dict[str, list[str]]) -> DataFrame:
    """id, kind, p: a softmax over the kinds' scores, which are the share of a kind's patterns in the text, and HINT more where the name has one of its hints."""
    text, name = F.coalesce("text", F.lit("")), F.lower(F.coalesce("name", F.lit("")))

    def score(kind: str) -> Column:
        share = sum((text.rlike(p).cast("int") for p in patterns[kind]), F.lit(0)) / F.lit(len(patterns[kind]))
        hinted = F.lit(False)
        for h in hints.get(kind, ()):
            hinted = hinted | F.contains(name, F.lit(h))
        return F.when(hinted, F.least(F.lit(1.0), share + HINT)).otherwise(share)

    scored = texts.where("id is not null").select("id", F.array(*[F.struct(F.lit(k).alias("kind"), score(k).alias("s")) for k in patterns]).alias("k"))
    scored = scored.withColumn("most", F.array_max(F.transform("k", lambda x: x["s"])))
    scored = scored.withColumn("all", F.aggregate("k", F.lit(0.0), lambda a, x: a + _softmax(x["s"], F.col("most"))))
    return scored.select("id", F.explode("k").alias("x"), "most", "all").select("id", "x.kind", (_softmax(F.col("x.s"), F.col("most")) / F.col("all")).alias("p"))
