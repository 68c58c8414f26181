"""Rules that go through a key's rows in order, each step resting on the one before: folds inside the JVM.

A key's rows are numbered and cut into pieces of PIECE rows; a piece is one array that `aggregate` folds. The state at a piece's end is
where the next one begins, so a key of many pieces takes as many rounds and no array is longer than a piece; all other keys are done in the first.

Defined results: rows with a null key take no part; rows equal in order are taken by value; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

PIECE = 1024


def fold(rows: DataFrame, keys: list[str], order: list[str], value: Column, zero: Column, step: Callable[[Column, Column], Column], between: Callable[[Column], Column] | None = None, piece: int = PIECE) -> DataFrame:
    """keys, piece, items (struct of _n, the order and _v), state after each piece's rows. step(state, item); between: what the next piece begins with."""
    known = rows.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, *order, value.alias("_v"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_v")) - 1
    items = F.sort_array(F.collect_list(F.struct("_n", *order, "_v")))
    pieces = known.withColumn("_n", number).groupBy(*keys, F.floor(F.col("_n") / piece).cast("int").alias("piece")).agg(items.alias("items"))
    pieces = staged(pieces, "pieces")
    last = pieces.agg(F.max("piece")).first()[0] or 0
    now = staged(pieces.where("piece = 0").withColumn("state", F.aggregate("items", zero, step)), "folded")
    made = now
    for k in range(1, last + 1):
        carried = now.select(*keys, (between(F.col("state")) if between else F.col("state")).alias("_from"))
        now = staged(pieces.where(F.col("piece") == k).join(carried, keys).select(*keys, "piece", "items", F.aggregate("items", F.col("_from"), step).alias("state")), "folded")
        made = made.union(now)
    return made


def _final(made: DataFrame, keys: list[str], state: Column) -> DataFrame:
    return made.groupBy(*keys).agg(F.max_by(state, "piece").alias("_s"), F.sum(F.size("items")).alias("updates"))


def moving_average(rows: DataFrame, keys: list[str], order: list[str], value: str, tenths: int = 3, piece: int = PIECE) -> DataFrame:
    """keys, updates, average: from 0 on, each value moves it by so many tenths, rounded to 4 places (half up) at every step.

    Steps are on whole ten-thousandths, so the rounding is that of decimals; values count to 4 places.
    """
    v = F.round(F.col(value).cast("decimal(28,6)") * 10000).cast("long")
    step = lambda s, x: F.floor((s * (10 - tenths) + x["_v"] * tenths + 5) / 10).cast("long")
    made = fold(rows.where(F.col(value).isNotNull()), keys, order, v, F.lit(0).cast("long"), step, piece=piece)
    return _final(made, keys, F.col("state")).select(*keys, "updates", (F.col("_s") / 10000).alias("average"))


def edge_strength(rows: DataFrame, keys: list[str], order: list[str], strength: str, piece: int = PIECE) -> DataFrame:
    """keys, updates, strength, learned: the first record sets an edge's strength, each later one moves it by 0.3, at most to 1; learned from 0.7 on."""
    v = F.col(strength).cast("double")
    step = lambda s, x: F.when(s.isNull(), x["_v"]).otherwise(F.least(F.lit(1.0), s * F.lit(0.7) + x["_v"] * F.lit(0.3)))
    made = fold(rows.where(F.col(strength).isNotNull()), keys, order, v, F.lit(None).cast("double"), step, piece=piece)
    return _final(made, keys, F.col("state")).select(*keys, "updates", F.col("_s").alias("strength"), (F.col("_s") >= 0.7).alias("learned"))


def _used(levels: int) -> Column:
    return F.array(*[F.lit(0).cast("long")] * levels)


def _add(used: Column, level: Column, by: Column) -> Column:
    return F.transform(used, lambda u, i: F.when(i + 1 == level, u + by).otherwise(u))


def _chosen(made: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A row for each item, with what was chosen for it."""
    pairs = made.select(*keys, F.explode(F.arrays_zip("items", F.col("state.out").alias("out"))).alias("p"))
    return pairs.select(*keys, *[F.col(f"p.items.{o}").alias(o) for o in order], F.col("p.items._v").alias("_v"), F.col("p.out").cast("int").alias("level"))


def recommended_levels(rows: DataFrame, keys: list[str], order: list[str], marks: str, targets: list[int], piece: int = PIECE) -> DataFrame:
    """keys, order, level: for each question in turn the level whose target marks (targets, from level 1 on) are the furthest from met;
    its marks then count as used there. Ties: the smaller level."""
    goal = F.array(*[F.lit(t).cast("long") for t in targets])

    def step(s: Column, x: Column) -> Column:
        lack = F.transform(s["used"], lambda u, i: F.get(goal, i) - u)
        level = F.array_position(lack, F.array_max(lack)).cast("int")
        return F.struct(_add(s["used"], level, x["_v"]).alias("used"), F.concat(s["out"], F.array(level)).alias("out"))

    none = F.array().cast("array<int>").alias("out")
    zero = F.struct(_used(len(targets)).alias("used"), none)
    made = fold(rows, keys, order, F.coalesce(F.col(marks).cast("long"), F.lit(0)), zero, step, lambda s: F.struct(s["used"].alias("used"), none), piece)
    return _chosen(made, keys, order).select(*keys, *order, "level")


def balanced_levels(rows: DataFrame, keys: list[str], order: list[str], preferred: str, levels: int = 6, often: int = 2, others: tuple[int, ...] = (2, 3, 4), piece: int = PIECE) -> DataFrame:
    """keys, order, level: the preferred level of each question in turn, unless it was chosen `often` times: then the least used of others (ties: the first)."""

    def step(s: Column, x: Column) -> Column:
        least = F.array_min(F.array(*[F.struct(F.get(s["used"], F.lit(o - 1)).alias("n"), F.lit(k).alias("k"), F.lit(o).alias("o")) for k, o in enumerate(others)]))["o"]
        level = F.when(F.get(s["used"], x["_v"] - 1) >= often, least).otherwise(x["_v"])
        return F.struct(_add(s["used"], level, F.lit(1)).alias("used"), F.concat(s["out"], F.array(level)).alias("out"))

    none = F.array().cast("array<int>").alias("out")
    known = rows.where(F.col(preferred).between(1, levels))
    made = fold(known, keys, order, F.col(preferred).cast("int"), F.struct(_used(levels).alias("used"), none), step, lambda s: F.struct(s["used"].alias("used"), none), piece)
    return _chosen(made, keys, order).select(*keys, *order, "level")
