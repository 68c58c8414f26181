"""Exact joins of similar sets of words, and the ordered removal of near duplicates.

All words have one order, and a set is only met through its prefix: the few first words of which two similar sets must have one in
common. Any order gives the same pairs, the less frequent the first words the fewer candidates. Words stand by their hashes, and those that more than OFTEN sets
would meet by come last, the most frequent at the end: only first words are counted for that, not all (for `left`, where a prefix meets whole sets, all are).
So a word that most sets have makes no candidates, unless a set has hardly any other. Candidates pass by size and by the place of the word they met on
(what comes after it bounds the overlap), then the whole sets decide. Nothing is approximate.

Measures, in per cent of: `union` both sets' union (at least), `larger` the larger set (more than), `left` the left set (more than).

Defined results: rows with a null id take no part; null words are left out, repeated words count once; a set without words is similar
to none; words are told apart by 64-bit hashes.

Joins are asked to merge: Spark takes the size of exploded words for that of the packed files they come from, and would
send them to the driver to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, staged

MEASURES = ("union", "larger", "left")
#: More sets than this that would meet by a word put it behind others: the most frequent words of a round, in so many rounds. What is left makes more candidates.
OFTEN, MOST, ROUNDS = 50, 100_000, 4
#: Turns in which pairs are compared at most.
TURNS = 16


def word_sets(rows: DataFrame, key: str, words: Column, *others: str, group: Column | None = None) -> DataFrame:
    """id and tokens (the distinct words as hashes), and other columns as they are. Words of unlike groups are unlike."""
    named = F.transform(F.filter(words, lambda w: w.isNotNull()), lambda w: F.xxhash64(w) if group is None else F.xxhash64(group, w))
    made = rows.select(F.col(key).alias("id"), F.coalesce(F.array_distinct(named), F.array().cast("array<long>")).alias("tokens"), *others)
    return made.where("id is not null")


def _marked(sets: DataFrame) -> DataFrame:
    """The sets with two hashes of all their words."""
    return sets.withColumn("_t", F.array_sort("tokens")).withColumns({"_a": F.xxhash64("_t"), "_b": F.xxhash64(F.lit("second"), "_t")}).drop("_t")


def classes(sets: DataFrame, order: str = "id") -> DataFrame:
    """The sets with class, the smallest `order` among rows of the same tokens. Copies needn't meet each other then."""
    marked = _marked(sets)
    first = marked.groupBy("_a", "_b").agg(F.min(order).alias("class"))
    return marked.join(first, ["_a", "_b"]).drop("_a", "_b")


def _least(n: Column, measure: str, per_cent: int) -> Column:
    """How many words a set of n has in common with every set it is similar to, at least."""
    return F.floor((n * per_cent + 99) / 100) if measure == "union" else F.floor(n * per_cent / 100) + 1


def _needed(n: Column, m: Column, measure: str, per_cent: int) -> Column:
    """How many words a left set of n and a right set of m must have in common."""
    if measure == "union":
        return F.ceil((n + m) * per_cent / (100 + per_cent))
    return _least(F.greatest(n, m) if measure == "larger" else n, measure, per_cent)


def _ranked(sets: DataFrame) -> DataFrame:
    """side, id, n, tokens: the tokens from the rarest on."""
    each = sets.select("side", "id", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df"))
    order = F.sort_array(F.collect_list(F.struct("df", "token")))  # a set's own words
    made = each.join(often.hint("merge"), "token").groupBy("side", "id").agg(order.alias("o"))
    return made.select("side", "id", F.size("o").alias("n"), F.transform("o", lambda x: x["token"]).alias("tokens"))


def _ordered(base: DataFrame, measure: str, per_cent: int) -> DataFrame:
    """side, id, n, tokens: the tokens, sorted by their hashes in base, with frequent ones of prefixes last. Whole sets aren't shuffled for that."""
    prefix = (F.col("n") - _least(F.col("n"), measure, per_cent) + 1).cast("int")
    often, made = {}, base
    for _ in range(ROUNDS):
        each = made.where("n > 0").select(F.explode(F.slice("tokens", 1, F.greatest(prefix, F.lit(0)))).alias("token"))
        found = each.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > OFTEN).orderBy(F.desc("df"), "token").limit(MOST).collect()
        new = {r["token"]: r["df"] for r in found if r["token"] not in often}
        if not new:
            break
        often |= new
        made = _behind(base, often)
    return made


def _behind(base: DataFrame, often: dict[int, int]) -> DataFrame:
    last = np.array(sorted(often), np.int64)
    df = np.array([often[t] for t in last.tolist()], np.int64)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            ends, words = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(last, words), len(last) - 1)
            order = np.lexsort((words, np.where(last[at] == words, df[at], 0), np.repeat(np.arange(b.num_rows), np.diff(ends))))
            made = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(words[order]))
            yield pa.RecordBatch.from_arrays([made if c == "tokens" else b.column(c) for c in b.schema.names], names=b.schema.names)

    return base.mapInArrow(put, base.schema)


def candidates(ranked: DataFrame, measure: str, per_cent: int, same: bool) -> DataFrame:
    """Pairs a (left), b (right) that have to be compared. same: both are rows of side 0, and a comes after b."""
    whole = measure == "left"  # the right set may be of any size, so only the left has a prefix
    prefix = F.col("n") - _least(F.col("n"), measure, per_cent) + 1

    def words(side: int, length: Column | None, key: str, size: str, place: str) -> DataFrame:
        some = F.col("tokens") if length is None else F.slice("tokens", 1, F.greatest(length.cast("int"), F.lit(0)))
        return ranked.where(F.col("side") == side).select(F.col("id").alias(key), F.col("n").alias(size), F.posexplode(some).alias(place, "token"))

    left, right = words(0, prefix, "a", "n", "i"), words(0 if same else 1, None if whole else prefix, "b", "m", "j")
    rest = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    enough = rest >= _needed(F.col("n"), F.col("m"), measure, per_cent)
    met = left.join(right.hint("merge"), "token").where(enough)
    return (met.where("a > b") if same else met).select("a", "b").distinct()


def similar(left: DataFrame, right: DataFrame | None = None, measure: str = "union", per_cent: int = 80) -> DataFrame:
    """a, b, n, m, both: pairs of similar sets (id, tokens) with their sizes and common words. Without right, pairs of left with a > b."""
    if measure not in MEASURES:
        raise ValueError(f"a measure is one of {MEASURES}")
    same = right is None
    sets = left.select(F.lit(0).alias("side"), "id", "tokens")
    if not same:
        sets = sets.union(right.select(F.lit(1).alias("side"), "id", "tokens"))
    base = staged(_ranked(sets) if measure == "left" else sets.select("side", "id", F.size("tokens").alias("n"), F.array_sort("tokens").alias("tokens")), "sets")
    ranked = base if measure == "left" else _ordered(base, measure, per_cent)
    met = staged(candidates(ranked, measure, per_cent, same), "met")
    # only sets that are met are compared, and shuffled again
    other = 0 if same else 1
    needed = met.select(F.lit(0).alias("side"), F.col("a").alias("id")).union(met.select(F.lit(other), "b")).distinct()
    whole = staged(ranked.join(needed.hint("merge"), ["side", "id"], "left_semi"), "whole")
    a = whole.where("side = 0").select(F.col("id").alias("a"), F.col("n"), F.col("tokens").alias("x"))
    b = whole.where(F.col("side") == other).select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    discard(base)
    # sets go from one join to the other with each of their pairs: pairs are compared in turns of about as many as there are sets
    turns, found = min(TURNS, max(1, -(-met.count() // max(1, whole.count())))), []
    for k in range(turns):
        some = met.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == k)
        both = some.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).alias("both"))
        found.append(staged(both.where(F.col("both") >= _needed(F.col("n"), F.col("m"), measure, per_cent)), "pairs"))
    discard(met, whole)
    return reduce(DataFrame.union, found)


def best_match(names: DataFrame, known: DataFrame, per_cent: int = 55) -> DataFrame:
    """id, match, similarity: of each name (id, tokens) the known name with the largest share of the union; ties to the smaller id.

    Names of the same words are looked up once, and known names of the same words are one, with the smallest id.
    """
    asked = staged(classes(names), "names")
    few = classes(known).where("id = class").dropDuplicates(["id"])
    pairs = similar(asked.where("id = class").dropDuplicates(["id"]), few, "union", per_cent)
    share = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    best = pairs.groupBy(F.col("a").alias("class")).agg(F.min(F.struct((-share).alias("s"), F.col("b").alias("match"))).alias("x"))
    return asked.join(best, "class").select("id", "x.match", F.round(-F.col("x.s"), 4).alias("similarity"))


def duplicate_classes(sets: DataFrame, per_cent: int = 80) -> DataFrame:
    """id, class_id, n_links: rows of equal sets are a class, named by its smallest id; links are the other classes that are similar to it."""
    marked, key = _marked(sets), ["id", "_a", "_b"]
    signed = staged(marked.select(*key), "signed")
    first = signed.groupBy("_a", "_b").agg(F.min("id").alias("class"))
    named = staged(signed.join(first, ["_a", "_b"]), "classes")
    discard(signed)
    one = marked.join(named.where("id = class").select(*key).hint("merge"), key, "left_semi").dropDuplicates(key).select("id", "tokens")
    pairs = similar(one, None, "union", per_cent)
    links = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).groupBy("class").agg(F.count("*").alias("n_links"))
    return named.join(links, "class", "left").select("id", F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_in_order(sets: DataFrame, per_cent: int = 75) -> DataFrame:
    """id, kept: going through the rows in the order of id, a row is dropped if more than per_cent of its words are in one kept before.

    Each round decides the rows all of whose earlier similar rows are decided, so there are as many rounds as the longest chain of
    rows that depend on each other; each is a few joins of the links still open. A later row of the same words is dropped, whether the
    first was kept (it is similar) or not (what drops the first drops it too), so only first rows are linked.
    """
    named = staged(classes(sets), "classes")
    first = named.where("id = class").dropDuplicates(["id"]).select("id", "tokens")
    later = first.select("id", "tokens")
    links = staged(_earlier(later, per_cent), "links")
    dropped, now = [], links
    while not now.isEmpty():
        waits = now.select(F.col("a").alias("b")).distinct()
        kept = now.select("b").distinct().join(waits, "b", "left_anti")
        gone = staged(now.join(kept, "b", "left_semi").select(F.col("a").alias("id")).distinct(), "gone")
        dropped.append(gone)
        left = now.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        before, now = now, staged(left, "links")
        if before is not links:
            discard(before)
    all_gone = links.select(F.col("a").alias("id")).limit(0)
    for d in dropped:
        all_gone = all_gone.union(d)
    marked = named.join(all_gone.withColumn("_gone", F.lit(True)), "id", "left")
    copy = (F.size("tokens") > 0) & (F.col("id") != F.col("class"))
    return marked.select("id", (~copy & F.col("_gone").isNull()).alias("kept"))


def _earlier(sets: DataFrame, per_cent: int) -> DataFrame:
    """Links a, b: more than per_cent of a's words are in b, which comes before."""
    right = sets.select("id", "tokens")
    return similar(sets, right, "left", per_cent).where("a > b").select("a", "b")
