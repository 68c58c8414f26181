"""Papers put together from ranked candidates and repaired: only slots that a check flags are filled again, from candidates not used yet.

slots: paper, slot, topic. candidates: topic, candidate, score, text. A topic's candidates have one order (score, then the smaller candidate); the slots of a
paper and topic take them in turn, and a slot that is filled again takes the next that its paper has not had. Nothing loops over papers or slots: a round is
a check and two joins over all papers at once, and a slot that isn't flagged keeps its row. Joins are asked to merge: what is read back packs
to a small part of what it takes in the driver's memory, where Spark would gather it to broadcast.

Defined results: rows with a null key take no part; a slot for which no candidate is left has none (null) and is not checked; equal candidates of a topic count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, staged
from . import similarity

REPAIRS = 2


def repeated(filled: DataFrame, per_cent: int = 80) -> DataFrame:
    """paper, slot: the slots whose question has more than per_cent of the words (of the larger of both) in common with an earlier one of its paper."""
    words = F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x20\x09-\x0D]+")
    rows = filled.where("candidate is not null").withColumn("id", F.struct("paper", "slot"))
    sets = similarity.word_sets(rows, "id", F.filter(words, lambda w: w != ""), group=F.col("paper"))
    pairs = similarity.similar(sets, None, "larger", per_cent)
    return pairs.select(F.col("a.paper").alias("paper"), F.col("a.slot").alias("slot")).distinct()


def assemble(slots: DataFrame, candidates: DataFrame, check: Callable[[DataFrame], DataFrame] = repeated, repairs: int = REPAIRS) -> DataFrame:
    """paper, slot, topic, rank, candidate, text, round: what each slot is filled with and in which round (0: at first) it was."""
    known = candidates.where("topic is not null and candidate is not null").groupBy("topic", "candidate").agg(F.max("score").alias("score"), F.min("text").alias("text"))
    place = Window.partitionBy("topic").orderBy(F.desc_nulls_last("score"), "candidate")
    ranked = staged(known.select("topic", "candidate", "text", F.row_number().over(place).alias("rank")), "candidates")
    turn = Window.partitionBy("paper", "topic").orderBy("slot")
    asked = slots.where("paper is not null and slot is not null and topic is not null").dropDuplicates(["paper", "slot"]).select("paper", "slot", "topic", F.row_number().over(turn).alias("rank"))
    cols = ["paper", "slot", "topic", "rank", "candidate", "text", "round"]
    now = staged(asked.join(ranked.hint("merge"), ["topic", "rank"], "left").withColumn("round", F.lit(0)).select(*cols), "papers")
    for k in range(1, repairs + 1):
        flagged = staged(check(now).select("paper", "slot", F.lit(True).alias("_again")).distinct(), "flagged")
        if flagged.isEmpty():
            break
        marked = now.join(flagged.hint("merge"), ["paper", "slot"], "left")
        had = F.max("rank").over(Window.partitionBy("paper", "topic"))
        again = marked.withColumn("_had", had).where("_again").select("paper", "slot", "topic", (F.col("_had") + F.row_number().over(turn)).alias("rank"))
        filled = again.join(ranked.hint("merge"), ["topic", "rank"], "left").withColumn("round", F.lit(k)).select(*cols)
        kept = marked.where("_again is null").select(*cols)
        before, now = now, staged(kept.union(filled), "papers")
        discard(before, flagged)
    return now
