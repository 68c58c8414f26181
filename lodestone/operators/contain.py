"""Which texts contain which patterns: an automaton of all patterns (Aho-Corasick) reads each text once.

The side of the patterns is measured first. Up to PATTERN_CHARS characters it becomes one automaton a worker, and texts
are scanned where they are, without a shuffle. Beyond it the patterns are dealt into shards below that size, and
each shard meets the texts in parts of a bounded size; no side is ever held whole. There is no join on a condition.

Defined results: a null text or pattern takes no part, nor does an empty pattern, unless a function says so; patterns equal in
text are met each, and an id may have several patterns; texts and patterns are compared as they are, code point by code point.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged

PATTERN_CHARS, PART_CHARS = 4 << 20, 32 << 20
_automata: dict[str, object] = {}


def automaton(patterns: list[tuple[int, str]], key: str):
    """One automaton of (id, pattern), kept by the worker until it is asked for another."""
    import ahocorasick

    if key not in _automata:
        _automata.clear()
        made, by = ahocorasick.Automaton(), {}
        for i, p in patterns:
            by.setdefault(p, []).append(i)
        for k, (p, ids) in enumerate(by.items()):
            made.add_word(p, (len(p), k, ids))
        if by:
            made.make_automaton()
        _automata[key] = made if by else None
    return _automata[key]


def _bounded(text: str, begin: int, end: int) -> bool:
    """No word goes on before begin or after end."""
    ok = lambda c: not (c.isalnum() or c == "_")
    return (begin == 0 or ok(text[begin - 1])) and (end == len(text) or ok(text[end]))


def found(text: str, made, whole_words: bool) -> list[int]:
    """Ids of the patterns in text, ascending, each once."""
    if made is None:
        return []
    done: set[int] = set()
    ids: set[int] = set()
    for last, (n, k, some) in made.iter(text):
        if k not in done and (not whole_words or _bounded(text, last + 1 - n, last + 1)):
            done.add(k)
            ids.update(some)
    return sorted(ids)


def matches(texts: DataFrame, patterns: DataFrame, whole_words: bool = False) -> DataFrame:
    """id, pattern: a row for each text (id, text) and each pattern (id, text; ids are longs) that it contains.

    whole_words: only where no letter, digit or underscore goes on at either end.
    """
    texts = texts.where("text is not null").select("id", "text")
    some = patterns.where("text <> ''").select(F.col("id").cast("long").alias("id"), "text")
    kind = texts.schema["id"].dataType.simpleString()
    key = uuid.uuid4().hex
    chars = some.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= PATTERN_CHARS:  # so it fits the driver and every worker
        listed = [(r[0], r[1]) for r in some.collect()]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = automaton(listed, key)
            for b in batches:
                hits = [found(t.as_py(), made, whole_words) for t in b.column(1)]
                at = [i for i, h in enumerate(hits) for _ in h]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([p for h in hits for p in h], pa.int64())], names=["id", "pattern"])

        return texts.mapInArrow(scan, f"id {kind}, pattern long")
    shards = -(-chars // PATTERN_CHARS)
    parts = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS))
    shard = F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")
    left = texts.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1).cast("int"))))
    right = some.withColumn("shard", shard).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1).cast("int"))))

    def meet(at, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        made = automaton(list(zip(p["id"].tolist(), p["text"], strict=True)), f"{key}-{at[0]}")
        hits = [found(x, made, whole_words) for x in t["text"]]
        return pd.DataFrame({"id": t["id"].repeat([len(h) for h in hits]).to_numpy(), "pattern": pd.Series([x for h in hits for x in h], dtype="int64")})

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(meet, f"id {kind}, pattern long").distinct()  # an id may have patterns in several shards


def first_either_way(topics: DataFrame, names: DataFrame) -> DataFrame:
    """id, first: of each topic (id, text) the smallest id of a name (id, text) that it contains or is contained in; null if there is none.

    What is empty is contained in everything.
    """
    topics, names = (df.select(F.col("id").cast("long").alias("id"), "text").where("text is not null") for df in (topics, names))
    of_all = names.agg(F.min("id").alias("any"), F.min(F.when(F.col("text") == "", F.col("id"))).alias("empty")).first()
    inside = matches(topics, names).groupBy("id").agg(F.min("pattern").alias("first"))
    around = matches(names, topics).groupBy(F.col("pattern").alias("id")).agg(F.min("id").alias("first"))
    best = inside.union(around).groupBy("id").agg(F.min("first").alias("first"))
    at_least = F.when(F.col("text") == "", F.lit(of_all["any"])).otherwise(F.lit(of_all["empty"])).cast("long")
    return topics.join(best, "id", "left").select("id", F.least("first", at_least).alias("first"))


def holding(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """id: the owners (id) of terms (id, text) of which at least one stands in some text (id, text)."""
    return matches(texts, terms).select(F.col("pattern").alias("id")).distinct()


def lookup(asked: DataFrame, library: DataFrame) -> DataFrame:
    """id, pass, entry: the library's entry for each question asked, by four passes; questions without any are left out.

    asked: id, topic, level, kind. library: entry (their order), keyword, level, kind; an empty keyword is generic. Passes: a keyword in the
    topic with level and kind; a keyword in the topic with level; generic with level and kind; generic with level. In each the first entry counts.
    """
    words = library.where("keyword <> ''")
    met = matches(asked.select("id", F.lower("topic").alias("text")), words.select(F.col("entry").alias("id"), F.col("keyword").alias("text")))
    q, e = asked.select("id", F.col("level").alias("_level"), F.col("kind").alias("_kind")), words.select(F.col("entry").alias("pattern"), "level", "kind")
    named = met.join(q, "id").join(e, "pattern").where("level = _level")
    by_word = named.select("id", F.when(F.col("kind") == F.col("_kind"), 1).otherwise(2).alias("pass"), F.col("pattern").alias("entry"))
    generic = library.where("keyword = ''").groupBy("level", "kind").agg(F.min("entry").alias("entry"))
    third = q.join(generic, (F.col("level") == F.col("_level")) & (F.col("kind") == F.col("_kind"))).select("id", F.lit(3).alias("pass"), "entry")
    any_kind = generic.groupBy("level").agg(F.min("entry").alias("entry"))
    fourth = q.join(any_kind, F.col("level") == F.col("_level")).select("id", F.lit(4).alias("pass"), "entry")
    best = by_word.union(third).union(fourth).groupBy("id").agg(F.min(F.struct("pass", "entry")).alias("b"))
    return best.select("id", "b.pass", "b.entry")


def rule_violations(texts: DataFrame, rules: DataFrame, terms: DataFrame) -> DataFrame:
    """id, rule, term: a text breaks a rule where a trigger of the rule stands in its evidence, and a forbidden term in its question but not there.

    texts: id, question, evidence, name. rules: rule, whole_words. terms: rule, role ('trigger' or 'forbidden'), term. A rule without triggers always
    holds. A trigger counts in the name too. Terms are compared in lower case, at word edges where the rule says so.
    """
    numbered = terms.select("rule", "role", F.lower("term").alias("text")).where("text <> ''").distinct()
    numbered = staged(numbered.join(rules.select("rule", "whole_words"), "rule").withColumn("id", F.xxhash64("rule", "role", "text")), "terms")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    sides = texts.select("id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), low(s).alias("text")) for s in ("question", "evidence", "name")])).alias("x")).select(F.struct("id", "x.side").alias("id"), "x.text")
    sides = staged(sides, "sides")
    met = None
    for whole in (False, True):
        some = matches(sides, numbered.where(F.col("whole_words") == whole).select("id", "text"), whole)
        met = some if met is None else met.union(some)
    met = staged(met.select(F.col("id.id").alias("id"), F.col("id.side").alias("side"), F.col("pattern").alias("term_id")), "met")
    named = numbered.select(F.col("id").alias("term_id"), "rule", "role", F.col("text").alias("term"))
    seen = met.join(named, "term_id")
    active = seen.where("role = 'trigger' and side in ('evidence', 'name')").select("id", "rule").distinct()
    bad = seen.where("role = 'forbidden' and side = 'question'").select("id", "rule", "term")
    grounded = seen.where("role = 'forbidden' and side = 'evidence'").select("id", "rule", "term")
    broken = bad.join(grounded, ["id", "rule", "term"], "left_anti")
    free = rules.select("rule").join(numbered.where("role = 'trigger'").select("rule").distinct(), "rule", "left_anti")
    return broken.join(active, ["id", "rule"], "left_semi").union(broken.join(free, "rule", "left_semi").select("id", "rule", "term")).distinct()
