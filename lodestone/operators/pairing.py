"""All pairs of rows that share a key, from blocks of rows: what is shuffled and sorted is a small part of what comes out.

The rows of a key are dealt into blocks of about BLOCK values; blocks meet, and a meeting is written out where it is read, in any task.
So a key with many rows is spread over all tasks, and n rows of a key shuffle n ** 2 / BLOCK values for their n ** 2 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a block. A task holds the pairs of two blocks at once.
BLOCK = 256


def blocks(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """key, _name, name: the values of each key in arrays of about BLOCK. Rows are distinct."""
    n = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    dealt = rows.join(n, key).select(*key, value, F.pmod(F.xxhash64(value), F.ceil(F.col("_n") / BLOCK)).alias(f"_{name}"))
    return dealt.groupBy(*key, f"_{name}").agg(F.collect_list(value).alias(name))


def spread(met: DataFrame, left: str, right: str, by: list[str]) -> DataFrame:
    """A row for each pair of the elements of two arrays, with their places _i and _j. by: columns that tell met's rows apart."""
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in met.columns if c not in (left, right)]
    dealt = met.repartition(n, *by)  # by a number, so that Spark doesn't join these few bytes into few tasks
    first = dealt.select(*rest, right, F.posexplode(left).alias("_i", left))
    return first.select(*rest, "_i", left, F.posexplode(right).alias("_j", right))


def resolved(wanted: DataFrame, named: DataFrame) -> DataFrame:
    """src, dst: rows (id, needs) and the other rows (id, name) whose name is what they need, in any case. Each pair once.

    A pair can come twice only if both its ids have several names, so only those pairs are compared.
    """

    def of(rows: DataFrame, text: str, name: str, many: str) -> DataFrame:
        made = rows.select(F.lower(F.col(text)).alias("key"), F.col("id").alias(name)).where(f"key is not null and {name} is not null").distinct()
        several = made.groupBy(name).agg((F.count("*") > 1).alias(many))
        return blocks(made.join(several, name), ["key", many], name, name)

    met = of(wanted, "needs", "src", "_a").join(of(named, "name", "dst", "_b"), "key")
    by = ["key", "_a", "_b", "_src", "_dst"]
    once = spread(met.where("not (_a and _b)"), "src", "dst", by).where("src <> dst").select("src", "dst")
    return once.union(spread(met.where("_a and _b"), "src", "dst", by).where("src <> dst").select("src", "dst").distinct())
