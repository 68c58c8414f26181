"""Whether a question keeps to its subject: acronyms, phrases and foreign terms have to stand in what it rests on. All lists are tables.

texts: id, subject, question, evidence, concepts (array). phrases: term. foreign: subject, term. permitted: subject, term. A term is grounded if it is a concept, a word of one,
a word of four ASCII letters or more of the evidence, or permitted in the subject.

- an acronym (two to five capitals; of three or more) that isn't grounded is unseen;
- a phrase in the question that isn't grounded, nor any of its words of four letters or more, is unseen if it begins with a capital there;
- a foreign term of the subject in the question that isn't grounded is unseen.

Defined results: rows with a null id take no part; null texts are empty; null lists too; an id is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contain

#: Fixed values.
SCENARIO = ("vehicle", "technician", "student", "case", "scenario", "study", "explain", "describe", "analyse", "illustrate", "binary", "tree")
PLAIN_WORDS = ("with", "from", "that", "this", "case", "study")
LEAST, A_TERM = 0.2, 0.25


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def integrity(texts: DataFrame, phrases: DataFrame, foreign: DataFrame, permitted: DataFrame) -> DataFrame:
    """id, unseen (array, in order of the terms), passed, score."""
    none = F.array().cast("array<string>")
    vocabulary = permitted.groupBy("subject").agg(F.collect_set(F.lower("term")).alias("_permitted"))
    profiled = permitted.select("subject").union(foreign.select("subject")).distinct().withColumn("_profile", F.lit(True))
    rows = texts.where("id is not null").select("id", "subject", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("question", "evidence")], F.coalesce(F.transform("concepts", F.lower), none).alias("concepts"))
    rows = rows.join(vocabulary, "subject", "left").join(profiled, "subject", "left")
    solid = F.filter(_words(F.col("evidence")), lambda w: w.rlike("^[a-z]{4,}$"))
    scenario = F.when(F.col("_profile"), F.array(*map(F.lit, SCENARIO))).otherwise(none)
    named = F.flatten(F.transform("concepts", lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != "")))
    rows = rows.withColumn("grounded", F.array_distinct(F.concat("concepts", named, solid, F.coalesce("_permitted", none), scenario))).select("id", "subject", "question", "grounded")
    acronyms = F.filter(F.split("question", r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z]{3,5}$") & ~F.lower(w).isin(*SCENARIO))
    by_acronym = rows.select("id", F.explode(F.array_distinct(F.filter(acronyms, lambda w: ~F.array_contains("grounded", F.lower(w))))).alias("term"))
    # phrases and foreign terms are met by one automaton; each is then held against the question it was found in
    listed = phrases.select(F.lower("term").alias("text"), F.lit(None).cast("string").alias("of")).union(foreign.select(F.lower("term"), F.col("subject").cast("string"))).where("text <> ''").distinct()
    listed = listed.withColumn("pattern", F.xxhash64("text", F.coalesce("of", F.lit("\0"))))
    met = contain.matches(rows.select("id", F.lower("question").alias("text")), listed.select(F.col("pattern").alias("id"), "text"), whole_words=True)
    found = met.join(listed, "pattern").join(rows, "id").where(~F.array_contains("grounded", F.col("text")))
    strange = F.filter(_words(F.col("text")), lambda w: (F.length(w) >= 4) & ~w.isin(*PLAIN_WORDS))
    capital = F.expr("question rlike concat('(?<![\\\\p{L}\\\\p{N}_])\\\\Q', upper(substr(text, 1, 1)), '\\\\E(?i)\\\\Q', substr(text, 2), '\\\\E(?![\\\\p{L}\\\\p{N}_])')")
    as_phrase = F.col("of").isNull() & ~F.col("text").isin(*SCENARIO) & (F.length("text") >= 3) & (F.size(strange) > 0) & ~F.arrays_overlap(strange, "grounded") & capital
    as_foreign = F.col("of") == F.col("subject").cast("string")
    bad = by_acronym.select("id", F.lower("term").alias("term")).union(found.where(as_phrase | as_foreign).select("id", F.col("text").alias("term"))).groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("unseen"))
    made = rows.select("id").join(bad, "id", "left").withColumn("unseen", F.coalesce("unseen", none))
    score = F.when(F.size("unseen") == 0, 1.0).otherwise(F.greatest(F.lit(LEAST), F.lit(1.0) - F.size("unseen") * A_TERM))
    return made.select("id", "unseen", (F.size("unseen") == 0).alias("passed"), F.round(score, 2).alias("score"))
