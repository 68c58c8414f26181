"""Exact dedup, upserts, diffs and merges keyed by content or id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, content: Column, order: str) -> DataFrame:
    """One row of each content: the first in order. A partial minimum of structs, so no key has to fit in one task."""
    named = df.withColumn("_k", content)
    return named.groupBy("_k").agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def last_by(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.coalesce(text, F.lit("")))), 256)


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, removed or modified."""
    o = old.select(F.col(key).alias("_o"), F.col(digest).alias("_od"))
    n = new.select(F.col(key).alias("_n"), F.col(digest).alias("_nd"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_od").eqNullSafe(F.col("_nd")), "modified")
    return o.join(n, F.col("_o") == F.col("_n"), "full_outer").select(F.coalesce("_o", "_n").alias(key), change.alias("change")).where("change is not null")


def merge_existing_wins(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))
