"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its weight's share of all words, never above `max_repeats` times its own size; what a capped
source leaves is shared by weight among the others. A document is repeated floor(target / size of the source)
times, and once more where its hash lies below the source's threshold. Thresholds come from histograms: words by
source and hash bucket give the bucket in which the budget ends, only that bucket is summed again by finer
buckets, and so on until the bucket at the border holds no more than one document. Selection is a filter on the
hash; nothing is sorted, and the same documents and budgets always give the same mix (a larger budget takes a
superset).

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own,
ordered last; documents with equal doc_id share a hash and are taken together; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, words

BITS, LEVELS = 12, 5
TOP = BITS * LEVELS
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """target of each source; sources: source, source_size. One row a source: windows over them stay small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_n", F.row_number().over(order))
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") - 1) % len(weights) + 1).cast("double"))
    cap = F.lit(float(max_repeats)) * F.col("source_size")
    by_level = Window.orderBy(F.col("_level"), F.col("_n"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    leveled = weighed.withColumn("_level", cap / F.col("weight")).select(
        "*",
        F.sum("source_size").over(every).alias("_all"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_open"),
        F.coalesce(F.sum(cap).over(before), F.lit(0.0)).alias("_capped"),
    )
    fill = leveled.withColumn("_fill", (F.col("_all") - F.col("_capped")) / F.col("_open"))
    level = F.max("_fill").over(every)  # it rises while sources below it are capped, then falls
    return fill.withColumn("target", F.least(F.col("weight") * level, cap)).select("source", "source_size", "target")


def _planned(docs: DataFrame, weights: tuple[int, ...], max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """The staged sizes, and the plan: source, source_size, target, base (whole copies), cut (hashes below get one more)."""
    sized = staged(docs.select(F.col("doc_id"), F.col("source"), F.size(words(F.col("text"))).cast("long").alias("size"), hash60(F.col("doc_id")).alias("h")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = staged(targets(sources, weights, max_repeats).select("*", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long").alias("base")), "targets")
    border = goals.select("source", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("edge"))
    border = border.where("left > 0")
    for level in range(LEVELS):
        width = 1 << (TOP - BITS * (level + 1))
        inside = sized.where("size > 0").join(border, sized["source"].eqNullSafe(border["source"])).select(border["source"].alias("source"), "left", "low", "h", "size")
        # low: the first hash of the bucket at the border; at the first level every hash lies in it
        inside = inside.where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + (width << BITS)))
        sums = inside.groupBy("source", "left", "low", F.floor((F.col("h") - F.col("low")) / F.lit(width)).alias("bucket")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = sums.withColumn("upto", F.sum("s").over(run)).where("upto + 0.5 >= left")
        at = at.groupBy("source").agg(F.min(F.struct("bucket", "upto", "s", "n", "left", "low")).alias("x")).select("source", "x.*")
        new = at.select("source", (F.col("left") - (F.col("upto") - F.col("s"))).alias("left"), (F.col("low") + F.col("bucket") * F.lit(width)).alias("low"), (F.col("low") + (F.col("bucket") + 1) * F.lit(width)).alias("edge"), "s", "n")
        border = staged(new, "border")
        if not border.where("n > 1").limit(1).count():
            break
    # what is left of the budget decides on the documents at the border: the nearer sum wins
    cuts = border.select("source", F.when(F.col("left") * 2 >= F.col("s"), F.col("edge")).otherwise(F.col("low")).alias("cut"))
    plan = goals.alias("g").join(cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.*", F.coalesce("c.cut", F.lit(0)).alias("cut"))
    return sized, plan


def _copies() -> Column:
    return F.when(F.col("d.size") > 0, F.col("p.base") + (F.col("d.h") < F.col("p.cut")).cast("long")).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size times copies) of every row of docs."""
    sized, plan = _planned(docs, weights, max_repeats)
    out = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return out.select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", _copies().alias("copies"), (F.col("d.size") * _copies()).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    _, plan = _planned(docs, weights, max_repeats)
    sized = docs.select(F.struct("*").alias("_row"), F.col("source"), F.size(words(F.col("text"))).alias("size"), hash60(F.col("doc_id")).alias("h"))
    out = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return out.select("d._row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))).alias("_n")).select("_row.*")
