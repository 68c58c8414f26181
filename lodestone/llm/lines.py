"""Line dedup: windows of three consecutive lines that occur more than once in the corpus lose every later occurrence.

Lines are compared without white space at their ends; blank lines are in no window and stay. Occurrences are
ordered by doc_id (null last) and position. The lines of a later occurrence go, save those that belong to the
first occurrence of the same window (as in a run of equal lines). Windows travel as 128-bit hashes and the first
occurrence is a map-side minimum, so a window that a third of all documents share sends one row a task; the join
that follows has a side that adaptive execution can split.

Defined results: a null or empty text has no lines and stays as it is; fewer than three lines: nothing goes; rows
equal in doc_id and text are one document met twice and get the same result; columns beside doc_id and text are
kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, order_id

WIDTH = 3


def _lines(text: Column) -> Column:
    """Non-blank lines, as structs of the place in the text and the stripped line."""
    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "").alias("x")))
    return F.filter(split, lambda s: s["x"] != "")


def _windows(keyed: DataFrame) -> DataFrame:
    def hashed(lines: Column) -> Column:
        of = lambda k: [F.get(lines, k - 1 + j)["x"] for j in range(WIDTH)]
        made = F.transform(F.sequence(F.lit(1), F.size(lines) - (WIDTH - 1)), lambda k: F.struct(k.alias("k"), F.xxhash64(*of(k)).alias("h1"), F.xxhash64(F.lit("second"), *of(k)).alias("h2")))
        return F.when(F.size(lines) >= WIDTH, made)

    return keyed.select("_id", "_th", F.explode(let(_lines(F.col("text")), hashed)).alias("w")).select("_id", "_th", "w.*")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """_row (the input row), kept_text, n_lines (not blank), n_removed and n_spans (maximal runs of removed lines)."""
    keyed = docs.select(F.struct("*").alias("_row"), order_id(F.col("doc_id")).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_th"), F.col("text"))
    windows = _windows(keyed)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("_id", "_th", "k")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(F.struct("_id", "_th", "k") > F.col("first"))
    same = (F.col("_id") == F.col("first._id")) & (F.col("_th") == F.col("first._th"))
    start = F.when(same, F.greatest(F.col("k"), F.col("first.k") + WIDTH)).otherwise(F.col("k"))
    gone = later.select("_id", "_th", F.explode(F.sequence(start, F.col("k") + (WIDTH - 1))).alias("k"))
    gone = gone.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("k")).alias("_gone"))
    joined = keyed.join(gone, ["_id", "_th"], "left").withColumn("_lines", _lines(F.col("text")))

    places = F.transform(F.col("_gone"), lambda k: F.get(F.col("_lines"), k - 1)["i"])
    split = F.split(F.col("text"), "\n")
    kept = let(split, lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), places), lambda i: F.get(s, i)), "\n"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last"))
    spans = F.aggregate("_gone", zero, lambda a, k: F.struct((a["n"] + (k != a["last"] + 1).cast("int")).alias("n"), k.alias("last")), lambda a: a["n"])
    none = F.col("_gone").isNull()
    return joined.select(
        "_row",
        F.when(none, F.col("text")).otherwise(kept).alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        F.when(none, 0).otherwise(spans).cast("long").alias("n_spans"),
    )
