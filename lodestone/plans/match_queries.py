"""Queries of set-similarity and containment joins. The SQL states each rule anew, as plain joins of everything with everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import contain, figures, folds, similarity
from ..sources.shared import work_path
from ..streaming import events as E
from ..streaming import learn

WORD = r"[^\x20\x09-\x0D]+"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _words(text: str, pattern: str = WORD) -> F.Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))


def _shingles(words: F.Column, n: int) -> F.Column:
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<string>"))


def doc_near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("ws", _words("text"))
    made = similarity.duplicate_classes(similarity.word_sets(docs, "doc_id", _shingles(F.col("ws"), 5)), 80)
    return made.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def name_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part").withColumn("words", F.filter(_words("p_name", r"[\p{L}\p{N}_]+"), lambda w: F.length(w) > 2))
    both = [similarity.word_sets(parts.where(F.col("p_partkey") % 2 == k), "p_partkey", F.col("words")) for k in (0, 1)]
    return similarity.best_match(*both, 55)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").withColumn("ws", _words("text"))


def paper_repeated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn stands twice in its paper, the second time with a word more."""
    turns = _read(spark, sf_dir, "conversations")
    again = turns.where("turn % 3 = 0").select("conv_id", "turn", F.concat(F.lit("And "), "text").alias("text"), F.lit(2).alias("part"))
    both = turns.select("conv_id", "turn", "text", F.lit(1).alias("part")).union(again).withColumn("id", F.struct("conv_id", "turn", "part"))
    pairs = similarity.similar(similarity.word_sets(both, "id", _words("text"), group=F.col("conv_id")), None, "larger", 80)
    at = lambda side, field, name: F.col(f"{side}.{field}").cast("int").alias(name)
    share = F.round(F.col("both") / F.greatest("n", "m"), 4).alias("overlap")
    return pairs.select(F.col("b.conv_id").alias("paper"), at("b", "turn", "mq_a"), at("b", "part", "part_a"), at("a", "turn", "mq_b"), at("a", "part", "part_b"), share)


def turn_sequential_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a role and conversation, in order; each also comes back at the conversation's end without its last word."""
    turns = _turns(spark, sf_dir)
    short = turns.where("size(ws) > 4").select("conv_id", "role", (F.col("turn") + 100000).alias("turn"), F.slice("ws", 1, F.size("ws") - 1).alias("ws"))
    rows = turns.select("conv_id", "role", "turn", "ws").union(short).withColumn("id", F.struct("conv_id", "role", "turn"))
    kept = similarity.keep_in_order(similarity.word_sets(rows, "id", F.col("ws"), group=F.struct("conv_id", "role")), 75)
    return kept.select("id.conv_id", "id.turn", "kept")


def _distinct_words(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """id, text: the distinct words, numbered in order. Words of a language are few beside its texts."""
    each = df.select(F.explode(_words(text, pattern)).alias("text")).distinct()
    return each.withColumn("id", F.row_number().over(Window.orderBy("text")).cast("long"))


def topic_first_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = _read(spark, sf_dir, "conversations").select(F.explode(_words("text", r"[\p{L}]{9,}")).alias("text")).distinct().withColumn("id", F.xxhash64("text"))
    made = contain.first_either_way(topics, _distinct_words(_read(spark, sf_dir, "benchmark"), "text", r"[\p{L}]{5,}"))
    return topics.join(made, "id").select(F.col("text").alias("topic"), F.col("first").alias("concept"))


def outcome_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _distinct_words(_read(spark, sf_dir, "benchmark"), "text", r"[\p{L}]{7,}")
    texts = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return contain.holding(terms, texts).join(terms, "id").select("id", F.col("text").alias("term"))


def reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library: each item's first long word as a keyword; every fifth entry is generic."""
    items = _read(spark, sf_dir, "benchmark")
    keyword = F.when(F.col("item_id") % 5 == 4, "").otherwise(F.regexp_extract(F.lower("text"), r"[\p{L}]{5,}", 0))
    library = items.select(F.col("item_id").alias("entry"), keyword.alias("keyword"), (F.col("item_id") % 3).cast("int").alias("level"), (F.floor(F.col("item_id") / 3) % 2).cast("int").alias("kind"))
    asked = _read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("topic"), (F.col("turn") % 4).cast("int").alias("level"), (F.col("conv_id") % 2).cast("int").alias("kind"))
    return contain.lookup(asked, library).select("id.conv_id", "id.turn", F.col("pass").cast("int").alias("pass"), "entry")


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule an item: its first three words of four letters are triggers, the next five are forbidden; every third has no trigger."""
    turns = _read(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    texts = turns.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("question"), after.alias("evidence"), F.col("role").alias("name"))
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule"), _words("text", r"[\p{L}]{4,}").alias("ws"))
    rules = items.select("rule", (F.col("rule") % 2 == 0).alias("whole_words"))
    terms = items.where("rule % 3 <> 0").select("rule", F.lit("trigger").alias("role"), F.explode(F.slice("ws", 1, 3)).alias("term")).union(items.select("rule", F.lit("forbidden"), F.explode(F.slice("ws", 4, 5))))
    made = contain.rule_violations(texts, rules, terms)
    return made.select("id.conv_id", "id.turn", "rule", "term")


def figure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's customer is the module: its orders are chunks over the pages of the year, its lines figures."""
    orders, lines = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    page = lambda day: F.floor(F.dayofyear(day) / 4).cast("int")
    start = page(F.col("o_orderdate"))
    chunks = orders.select(F.col("o_custkey").alias("module"), F.col("o_orderkey").alias("chunk"), start.alias("page_start"), (start + F.col("o_orderkey") % 6).cast("int").alias("page_end"), F.concat_ws(" ", "o_orderpriority", F.lit("figure order"), F.when(F.col("o_orderkey") % 2 == 0, "shipped late")).alias("text"))
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    figs = lines.withColumn("n", number).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    figs = figs.select(F.col("o_custkey").alias("module"), (F.col("l_orderkey") * 100 + F.col("n")).alias("figure"), page(F.col("l_shipdate")).alias("page"), (F.col("l_discount") * 10).alias("provenance"), F.when(F.col("l_returnflag") == "R", "shipped late figure").otherwise("urgent order").alias("text"))
    return figures.assign(figures.scores(figs, chunks))


def ema_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.moving_average(_read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


def edge_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_shipdate", "l_orderkey", "l_partkey", (F.col("l_quantity") / 50).alias("s"))
    made = folds.edge_strength(lines, ["l_suppkey", "l_linenumber"], ["l_shipdate", "l_orderkey", "l_partkey"], "s")
    return made.select("l_suppkey", "l_linenumber", "updates", F.round("strength", 9).alias("strength"), "learned")


def recommended_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").withColumn("marks", F.col("l_quantity").cast("int"))
    return folds.recommended_levels(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "marks", [5, 10, 15, 10, 8, 2])


def balanced_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").withColumn("preferred", (F.col("l_suppkey") % 6 + 1).cast("int"))
    return folds.balanced_levels(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "preferred")


def stream_learned_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in several files, one a batch; their lines are the objects."""
    base = work_path(spark, "learn")
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.lit(0).alias("modified"), "text")
    docs.repartition(4, "path").write.parquet(f"{base}/in")

    def parse(files: DataFrame) -> DataFrame:
        return files.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where("line <> ''").select(F.md5("line").alias("object_id"), F.length("line").alias("n"))

    learner = learn.Learner(base, parse, enough=1)
    learner.run(E.file_stream(spark, f"{base}/in", 1))
    made = learner.table(spark, "objects")
    return made.select("object_id", F.col("n").cast("long").alias("n")) if made is not None else spark.createDataFrame([], "object_id string, n long")


QUERIES = {f.__name__: f for f in (doc_near_dup_jaccard, name_best_match, paper_repeated_questions, turn_sequential_dedup, topic_first_concept, outcome_terms, reference_lookup, rule_violations, figure_chunks, ema_steps, edge_strength, recommended_levels, balanced_levels, stream_learned_objects)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["doc_near_dup_jaccard"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(2, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS set FROM w),
c AS MATERIALIZED (SELECT md5(CAST(set AS VARCHAR)) AS key, min(doc_id) AS class_id, any_value(set) AS set FROM s GROUP BY key),
e AS MATERIALIZED (SELECT class_id, len(set) AS n, unnest(set) AS x FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, a.n + b.n - count(*) AS union_, count(*) AS met FROM e a JOIN e b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n),
l AS (SELECT a, count(*) AS n FROM p WHERE met * 100 >= 80 * union_ GROUP BY a)
SELECT s.doc_id, c.class_id, coalesce(l.n, 0) AS n_links FROM s JOIN c ON md5(CAST(s.set AS VARCHAR)) = c.key LEFT JOIN l ON l.a = c.class_id
"""

ORACLE_SQL["name_best_match"] = r"""
WITH w AS (SELECT p_partkey AS id, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+'), lambda x: length(x) > 2)) AS ws FROM part),
m AS (SELECT a.id, b.id AS match, CAST(len(list_intersect(a.ws, b.ws)) AS DOUBLE) / len(list_distinct(list_concat(a.ws, b.ws))) AS s FROM w a JOIN w b ON a.id % 2 = 0 AND b.id % 2 = 1 AND len(a.ws) > 0)
SELECT id, match, round(s, 4) AS similarity FROM m WHERE s >= 0.55 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, match) = 1
"""

ORACLE_SQL["paper_repeated_questions"] = r"""
WITH q AS (SELECT conv_id AS paper, CAST(turn AS INT) AS mq, 1 AS part, text FROM conversations UNION ALL SELECT conv_id, CAST(turn AS INT), 2, 'And ' || text FROM conversations WHERE turn % 3 = 0),
w AS (SELECT paper, mq, part, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')) AS ws FROM q),
p AS (SELECT a.paper, a.mq AS mq_a, a.part AS part_a, b.mq AS mq_b, b.part AS part_b, CAST(len(list_intersect(a.ws, b.ws)) AS DOUBLE) / greatest(len(a.ws), len(b.ws), 1) AS share
  FROM w a JOIN w b ON a.paper = b.paper AND (a.mq, a.part) < (b.mq, b.part))
SELECT paper, mq_a, part_a, mq_b, part_b, round(share, 4) AS overlap FROM p WHERE share > 0.8
"""

ORACLE_SQL["turn_sequential_dedup"] = r"""
WITH RECURSIVE t AS (SELECT conv_id, role, turn, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM conversations),
r AS (SELECT conv_id, role, turn, list_distinct(ws) AS ws FROM t UNION ALL SELECT conv_id, role, turn + 100000, list_distinct(ws[1:len(ws) - 1]) FROM t WHERE len(ws) > 4),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM r),
go AS (
  SELECT conv_id, role, turn, k, true AS kept, [ws] AS before FROM n WHERE k = 1
  UNION ALL
  SELECT n.conv_id, n.role, n.turn, n.k, x.kept, CASE WHEN x.kept THEN list_append(go.before, n.ws) ELSE go.before END
  FROM go JOIN n ON n.conv_id = go.conv_id AND n.role = go.role AND n.k = go.k + 1,
  LATERAL (SELECT len(list_filter(go.before, lambda b: len(list_intersect(n.ws, b)) * 4 > 3 * len(n.ws))) = 0 AS kept) x)
SELECT conv_id, turn, kept FROM go
"""

ORACLE_SQL["topic_first_concept"] = r"""
WITH topics AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}]{9,}')) AS topic FROM conversations),
names AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]{5,}')) AS word FROM benchmark))
SELECT topic, min(id) AS concept FROM topics LEFT JOIN names ON contains(topic, word) OR contains(word, topic) GROUP BY topic
"""

ORACLE_SQL["outcome_terms"] = r"""
WITH names AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]{7,}')) AS word FROM benchmark))
SELECT id, word AS term FROM names WHERE EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), word))
"""

ORACLE_SQL["reference_lookup"] = r"""
WITH lib AS (SELECT item_id AS entry, CASE WHEN item_id % 5 = 4 THEN '' ELSE regexp_extract(lower(text), '[\p{L}]{5,}') END AS keyword, CAST(item_id % 3 AS INT) AS level, CAST(item_id // 3 % 2 AS INT) AS kind FROM benchmark),
p AS (SELECT conv_id, turn, entry, CASE WHEN keyword <> '' AND lib.kind = conv_id % 2 THEN 1 WHEN keyword <> '' THEN 2 WHEN lib.kind = conv_id % 2 THEN 3 ELSE 4 END AS pass
  FROM conversations JOIN lib ON lib.level = turn % 4 AND contains(lower(text), keyword))
SELECT conv_id, turn, pass, entry FROM p QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY pass, entry) = 1
"""

ORACLE_SQL["rule_violations"] = r"""
WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q, lower(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS e, lower(coalesce(role, '')) AS name FROM conversations),
i AS (SELECT item_id AS rule, regexp_extract_all(lower(text), '[\p{L}]{4,}') AS ws FROM benchmark),
w AS (SELECT *, regexp_split_to_array(q, '[^\p{L}\p{N}_]+') AS qs, regexp_split_to_array(e, '[^\p{L}\p{N}_]+') AS es, regexp_split_to_array(name, '[^\p{L}\p{N}_]+') AS ns FROM t),
f AS (SELECT DISTINCT rule, unnest(ws[4:8]) AS term FROM i),
trig AS (SELECT rule, unnest(ws[1:3]) AS term FROM i WHERE rule % 3 <> 0),
bad AS (SELECT conv_id, turn, rule, term FROM w JOIN f ON CASE WHEN rule % 2 = 0 THEN list_contains(qs, term) AND NOT list_contains(es, term) ELSE contains(q, term) AND NOT contains(e, term) END),
live AS (SELECT DISTINCT conv_id, turn, rule FROM w JOIN trig ON CASE WHEN rule % 2 = 0 THEN list_contains(es, term) OR list_contains(ns, term) ELSE contains(e, term) OR contains(name, term) END)
SELECT bad.* FROM bad LEFT JOIN live USING (conv_id, turn, rule) WHERE rule % 3 = 0 OR live.conv_id IS NOT NULL
"""

_FOLD_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"

ORACLE_SQL["figure_chunks"] = r"""
WITH RECURSIVE c AS (SELECT o_custkey AS module, o_orderkey AS chunk, dayofyear(o_orderdate) // 4 AS s, dayofyear(o_orderdate) // 4 + o_orderkey % 6 AS e,
    list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', o_orderpriority, 'figure order', CASE WHEN o_orderkey % 2 = 0 THEN 'shipped late' END)), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{4,}'))) AS w FROM orders),
f AS (SELECT o_custkey AS module, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS figure, dayofyear(l_shipdate) // 4 AS page, l_discount * 10 AS prov,
    CASE WHEN l_returnflag = 'R' THEN ['shipped', 'late', 'figure'] ELSE ['urgent', 'order'] END AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT f.module, figure, prov, chunk, CASE WHEN page BETWEEN s AND e THEN 0.6::DOUBLE ELSE greatest(0::DOUBLE, 0.4::DOUBLE - least(abs(page - s), abs(page - e)) * 0.08::DOUBLE) END AS base,
    len(list_intersect(f.w, c.w)) / CAST(greatest(len(f.w), len(c.w)) AS DOUBLE) AS kw FROM f JOIN c ON f.module = c.module AND page BETWEEN s - 3 AND e + 3),
v AS (SELECT module, figure, prov, chunk, base + CASE WHEN base > 0 AND kw >= 0.12::DOUBLE THEN kw * 0.3::DOUBLE ELSE 0 END + prov * 0.1::DOUBLE AS score FROM p),
n AS (SELECT module, figure, list({'c': chunk, 's': score}) AS offers, row_number() OVER (PARTITION BY module ORDER BY max(prov) DESC, figure) AS k FROM v WHERE score > 0 GROUP BY module, figure),
go AS (
  SELECT module, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS figure, CAST(NULL AS STRUCT(v DOUBLE, c BIGINT)) AS best, CAST([] AS BIGINT[]) AS taken FROM n WHERE k = 1
  UNION ALL
  SELECT n.module, n.k, n.figure, x.best, list_append(go.taken, x.best.c)
  FROM go JOIN n ON n.module = go.module AND n.k = go.k + 1,
  LATERAL (SELECT list_sort(list_transform(n.offers, lambda o: {'v': -round(CASE WHEN len(list_filter(go.taken, lambda t: t = o.c)) >= 2 THEN o.s * 0.3::DOUBLE ELSE o.s END, 4), 'c': o.c}))[1] AS best) x)
SELECT module, figure, best.c AS chunk, -best.v AS score FROM go WHERE figure IS NOT NULL
"""

ORACLE_SQL["ema_steps"] = """
WITH l AS (SELECT user_id, count(*) AS updates, list(CAST(round(CAST(value AS DECIMAL(18,6)) * 10000) AS BIGINT) ORDER BY ts, event_id) AS vs FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, updates, list_reduce(list_prepend(0, vs), lambda s, v: (7 * s + 3 * v + 5) // 10) / 10000.0::DOUBLE AS average FROM l
"""

ORACLE_SQL["edge_strength"] = """
WITH l AS (SELECT l_suppkey, l_linenumber, count(*) AS updates, list(l_quantity / 50 ORDER BY l_shipdate, l_orderkey, l_partkey, l_quantity) AS vs FROM lineitem GROUP BY l_suppkey, l_linenumber),
s AS (SELECT *, list_reduce(vs, lambda s, v: least(1::DOUBLE, s * 0.7::DOUBLE + v * 0.3::DOUBLE)) AS strength FROM l)
SELECT l_suppkey, l_linenumber, updates, round(strength, 9) AS strength, strength >= 0.7::DOUBLE AS learned FROM s
"""

ORACLE_SQL["recommended_levels"] = f"""
WITH RECURSIVE n AS (SELECT *, CAST(l_quantity AS INT) AS marks, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_FOLD_ORDER}) AS k FROM lineitem),
go AS (
  SELECT l_orderkey, CAST(0 AS BIGINT) AS k, CAST(NULL AS INT) AS l_linenumber, CAST(NULL AS BIGINT) AS l_partkey, CAST(NULL AS BIGINT) AS l_suppkey, CAST(NULL AS DOUBLE) AS l_extendedprice, CAST(NULL AS INT) AS level, [5, 10, 15, 10, 8, 2] AS lack FROM n WHERE k = 1
  UNION ALL
  SELECT n.l_orderkey, n.k, n.l_linenumber, n.l_partkey, n.l_suppkey, n.l_extendedprice, x.level, list_transform(go.lack, lambda u, i: CASE WHEN i = x.level THEN u - n.marks ELSE u END)
  FROM go JOIN n ON n.l_orderkey = go.l_orderkey AND n.k = go.k + 1, LATERAL (SELECT CAST(list_position(go.lack, list_max(go.lack)) AS INT) AS level) x)
SELECT l_orderkey, {_FOLD_ORDER}, level FROM go WHERE level IS NOT NULL
"""

ORACLE_SQL["balanced_levels"] = f"""
WITH RECURSIVE n AS (SELECT *, CAST(l_suppkey % 6 + 1 AS INT) AS want, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_FOLD_ORDER}) AS k FROM lineitem),
go AS (
  SELECT l_orderkey, CAST(0 AS BIGINT) AS k, CAST(NULL AS INT) AS l_linenumber, CAST(NULL AS BIGINT) AS l_partkey, CAST(NULL AS BIGINT) AS l_suppkey, CAST(NULL AS DOUBLE) AS l_extendedprice, CAST(NULL AS INT) AS level, [0, 0, 0, 0, 0, 0] AS used FROM n WHERE k = 1
  UNION ALL
  SELECT n.l_orderkey, n.k, n.l_linenumber, n.l_partkey, n.l_suppkey, n.l_extendedprice, x.level, list_transform(go.used, lambda u, i: CASE WHEN i = x.level THEN u + 1 ELSE u END)
  FROM go JOIN n ON n.l_orderkey = go.l_orderkey AND n.k = go.k + 1,
  LATERAL (SELECT CASE WHEN go.used[n.want] < 2 THEN n.want WHEN go.used[2] <= go.used[3] AND go.used[2] <= go.used[4] THEN 2 WHEN go.used[3] <= go.used[4] THEN 3 ELSE 4 END AS level) x)
SELECT l_orderkey, {_FOLD_ORDER}, level FROM go WHERE level IS NOT NULL
"""

ORACLE_SQL["stream_learned_objects"] = """
SELECT DISTINCT md5(line) AS object_id, length(line) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE line <> ''
"""
