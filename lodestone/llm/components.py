"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge; edges: columns a, b of one orderable type.

    Every step is a partial minimum and joins that can be split, so a hub costs no task more than its share. Steps
    are written to the shared folder, in at most `files` files where given; the number of steps grows with the logarithm
    of the longest chain.
    """
    spark = edges.sparkSession
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", files)
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark = sign(now)
    while mark[0]:
        new = staged(_small_star(_large_star(now)), "edges", files)
        discard(spark, now)
        now, old, mark = new, mark, sign(new)
        if mark == old:
            break
    roots = now.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("b"))
    return now.union(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
