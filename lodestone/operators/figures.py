"""Figures and the chunks of text they belong to: a band join on pages, then an assignment by deferred acceptance.

figures: module, figure, page, provenance, text. chunks: module, chunk (their order), page_start, page_end, text.

A figure is offered the chunks of its module whose pages it lies on or within NEAR of an end of. The first two figures of a
chunk take it at full value, any further one at a part of it. Figures choose in the order of their provenance (ties: the
smaller figure). The modules of a task are gone through in that order, with nothing held but how many figures the chunks of the module at hand have. In a
module of more than LARGE figures all figures propose at once, each to its best offer; a chunk keeps the two that come first and turns the
others away, who propose to their next offer. As all chunks rank figures alike, this ends where the one by one rule does, in a few rounds.

Defined results: a row with a null module, figure, page, chunk or page range takes no part; a null text is empty, a null provenance 0; a figure
near no chunk is not assigned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, staged

#: Fixed values.
ON_PAGE, BESIDE, LESS_A_PAGE, NEAR = 0.60, 0.40, 0.08, 3
OVERLAP_FROM, OVERLAP, PROVENANCE = 0.12, 0.30, 0.10
SEATS, FULL = 2, 0.30
#: Pages of a bucket of the band join.
BUCKET = 8
#: Figures of a module that one task goes through.
LARGE = 100_000


def keywords(text: Column) -> Column:
    """Distinct words of four ASCII letters or more."""
    each = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.filter(each, lambda w: w.rlike("^[a-z]{4,}$")))


def scores(figures: DataFrame, chunks: DataFrame) -> DataFrame:
    """module, figure, provenance, chunk, score of the pairs that are near, before any chunk has figures; bucket, of the figure's page."""
    bucket = lambda page: F.floor(page / BUCKET)
    f = figures.select("module", "figure", "page", F.coalesce("provenance", F.lit(0.0)).alias("provenance"), "text", bucket(F.col("page")).alias("bucket")).where("module is not null and figure is not null and page is not null")
    reach = F.sequence(bucket(F.col("page_start") - NEAR), bucket(F.col("page_end") + NEAR))
    whole = chunks.where("module is not null and chunk is not null and page_start <= page_end")
    c = whole.select("module", "chunk", "page_start", "page_end", "text", F.explode(reach).alias("bucket"))
    # texts are shuffled, their words are split where they are used
    f, c = (x.repartition("module", "bucket").withColumn(w, keywords(F.col("text"))).drop("text") for x, w in ((f, "fw"), (c, "cw")))
    met = f.join(c, ["module", "bucket"]).where((F.col("page") >= F.col("page_start") - NEAR) & (F.col("page") <= F.col("page_end") + NEAR))
    away = F.least(F.abs(F.col("page") - F.col("page_start")), F.abs(F.col("page") - F.col("page_end")))
    place = F.when(F.col("page").between(F.col("page_start"), F.col("page_end")), F.lit(ON_PAGE)).otherwise(F.greatest(F.lit(0.0), BESIDE - away * LESS_A_PAGE))
    most = F.greatest(F.size("fw"), F.size("cw"))
    shared = F.when((F.size("fw") > 0) & (F.size("cw") > 0), F.size(F.array_intersect("fw", "cw")) / most).otherwise(F.lit(0.0))
    made = met.withColumn("_place", place).withColumn("_shared", shared)
    score = F.col("_place") + F.when((F.col("_place") > 0) & (F.col("_shared") >= OVERLAP_FROM), F.col("_shared") * OVERLAP).otherwise(F.lit(0.0)) + F.col("provenance") * PROVENANCE
    return made.select("module", "figure", "provenance", "chunk", score.alias("score"), "bucket").where("score > 0")


def assign(scored: DataFrame) -> DataFrame:
    """module, figure, chunk, score: each figure's chunk, and what it was worth when the figure came. scored: rows of scores."""
    who = ["module", "figure", "provenance"]
    # a figure's rows have one bucket and are together already
    lists = scored.groupBy(*who, *(["bucket"] if "bucket" in scored.columns else [])).agg(F.collect_list(F.struct("chunk", "score")).alias("offers"))
    lists = staged(lists.select(*who, "offers"), "offers")
    large = staged(lists.groupBy("module").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("module"), "large")
    if large.isEmpty():
        return _in_turn(lists)
    return _in_turn(lists.join(large, "module", "left_anti")).union(_in_rounds(lists.join(large, "module", "left_semi")))


def _in_turn(lists: DataFrame) -> DataFrame:
    """The figures of a module one by one, in a task."""
    seat, beside = F.transform("offers", lambda o: F.round(o["score"], 4)), F.transform("offers", lambda o: F.round(o["score"] * FULL, 4))
    made = lists.repartition("module").sortWithinPartitions("module", -F.col("provenance"), "figure").select("module", "figure", "provenance", F.col("offers.chunk").alias("chunk"), seat.alias("seat"), beside.alias("beside"))
    kinds = dict(made.dtypes)
    schema = f"module {kinds['module']}, figure {kinds['figure']}, chunk {kinds['chunk'].removeprefix('array<').removesuffix('>')}, score double"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, offers, taken, out, types = None, [], {}, [], None

        def settle() -> None:
            worth, c = min((-part if taken.get(c, 0) >= SEATS else -full, c) for c, full, part in offers)
            taken[c] = taken.get(c, 0) + 1
            out.append((last[0], last[2], c, -worth))

        def told() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], ["module", "figure", "chunk", "score"])
            out.clear()
            return rows

        for b in batches:
            types = [b.column("module").type, b.column("figure").type, b.column("chunk").type.value_type, pa.float64()]
            ends = b.column("chunk").offsets.to_pylist()
            each = list(zip(*(b.column(c).flatten().to_pylist() for c in ("chunk", "seat", "beside")), strict=True))
            for k, who in enumerate(zip(*(b.column(c).to_pylist() for c in ("module", "provenance", "figure")), strict=True)):
                mine = each[ends[k] - ends[0] : ends[k + 1] - ends[0]]
                if who == last:  # a figure with rows on pages of several buckets
                    offers = offers + mine
                    continue
                if last is not None:
                    settle()
                    if last[0] != who[0]:
                        taken.clear()
                last, offers = who, mine
            if out:
                yield told()
        if last is not None:
            settle()
            yield told()

    return made.mapInArrow(choose, schema)


def _in_rounds(lists: DataFrame) -> DataFrame:
    scored = lists.select("module", "figure", "provenance", F.explode("offers").alias("o")).select("module", "figure", "provenance", "o.chunk", "o.score")
    each = scored.select("module", F.struct((-F.col("provenance")).alias("p"), "figure").alias("who"), "chunk", F.explode(F.array(F.struct(F.lit(True).alias("seat"), F.round("score", 4).alias("score")), F.struct(F.lit(False).alias("seat"), F.round(F.col("score") * FULL, 4).alias("score")))).alias("o"))
    wish = Window.partitionBy("module", "who").orderBy(F.desc("o.score"), "chunk", F.desc("o.seat"))
    offers = staged(each.select("module", "who", "chunk", "o.seat", "o.score", F.row_number().over(wish).alias("wish")), "offers")
    now = staged(offers.select("module", "who").distinct().withColumn("wish", F.lit(1)), "wishes")
    first = Window.partitionBy("module", "chunk").orderBy("who")
    while True:
        asked = offers.join(now, ["module", "who", "wish"]).where("seat")
        kept = asked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SEATS)
        away = staged(asked.join(kept.select("module", "who"), ["module", "who"], "left_anti").select("module", "who"), "away")
        if away.isEmpty():
            break
        moved = now.join(away.withColumn("_more", F.lit(1)), ["module", "who"], "left").select("module", "who", (F.col("wish") + F.coalesce("_more", F.lit(0))).alias("wish"))
        before, now = now, staged(moved, "wishes")
        discard(before, away)
    return offers.join(now, ["module", "who", "wish"]).select("module", "who.figure", "chunk", "score")
