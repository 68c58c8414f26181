"""Queries of page filters, paper assembly and domain gates, with SQL that states each rule anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import CHUNK_VOCABULARY
from ..operators import assembly, classify, cleaners, domain, packers, pages, questions, search


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines are pages; of two thirds of the suppliers the parts of a size below 26 are a table of contents."""
    line = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), line.alias("page"), "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    kind = F.when(F.col("doc") % 7 == 0, "toc").when(F.col("page") == 1, "title").when(F.col("page") < 4, "front_matter").when(F.col("l_quantity") > 45, "back_matter").when(F.col("l_returnflag") == "A", "body").otherwise("unknown")
    made = rows.select("doc", "page", kind.alias("class"), F.when(F.col("l_linestatus") == "F", "Appendix A").alias("heading"), (F.col("l_discount") > 0.05).alias("dense"))
    ranges = _read(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 400).cast("int").alias("start"), (F.col("o_orderkey") % 400 + F.col("o_orderkey") % 40).cast("int").alias("end"), F.when(F.col("o_orderstatus") == "P", "Appendix").otherwise("Chapter").alias("title"))
    places = made.where("doc % 5 > 0").select("doc", (F.col("page") - 3).alias("printed"), "page")
    return pages.kept_pages(made, ranges, places)


def paper_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a paper, its lines are slots; topics are brands, their parts the candidates."""
    parts = _read(spark, sf_dir, "part")
    candidates = parts.select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("candidate"), F.col("p_size").alias("score"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    slots = _read(spark, sf_dir, "lineitem").withColumn("slot", number).join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper"), "slot", F.col("p_brand").alias("topic"))
    return assembly.assemble(slots, candidates).select("paper", "slot", "topic", F.col("rank").cast("long").alias("rank"), "candidate", F.col("round").cast("long").alias("round"))


def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as questions, the next turn as evidence; items give each of four subjects foreign and permitted words, and phrases of two words."""
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]{4,}"), F.lit(0))
    turns = _read(spark, sf_dir, "conversations")
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    texts = turns.select(F.struct("conv_id", "turn").alias("id"), (F.col("conv_id") % 4).alias("subject"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " See ECU.").otherwise("")).alias("question"), after.alias("evidence"), F.array(F.col("role"), F.when(F.col("conv_id") % 2 == 0, "The ecu")).alias("concepts"))
    texts = texts.withColumn("concepts", F.array_compact("concepts"))
    items = _read(spark, sf_dir, "benchmark").select((F.col("item_id") % 3).alias("subject"), word(F.col("text")).alias("ws"), F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+ [\p{L}]+"), F.lit(0)).alias("two"))
    foreign = items.select("subject", F.explode(F.slice("ws", 1, 6)).alias("term"))
    permitted = items.select("subject", F.explode(F.slice("ws", 5, 3)).alias("term"))
    phrases = items.select(F.explode("two").alias("term")).union(items.select(F.explode(F.slice("ws", 8, 3)))).distinct()
    made = domain.integrity(texts, phrases, foreign, permitted)
    return made.select("id.conv_id", "id.turn", F.array_join("unseen", ",").alias("unseen"), "passed", "score")


QUERIES = {f.__name__: f for f in (page_filter, paper_assembly, domain_gate)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["page_filter"] = """
WITH r AS (SELECT l_suppkey AS doc, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) AS page, * FROM lineitem),
p AS (SELECT doc, page, CASE WHEN doc % 7 = 0 THEN 'toc' WHEN page = 1 THEN 'title' WHEN page < 4 THEN 'front' WHEN l_quantity > 45 THEN 'back' WHEN l_returnflag = 'A' THEN 'body' ELSE 'unknown' END AS class, l_discount > 0.05 AS dense FROM r),
t AS (SELECT o_custkey AS doc, o_orderkey % 400 + 3 AS lo, o_orderkey % 400 + o_orderkey % 40 + 3 AS hi, o_orderstatus FROM orders WHERE o_custkey % 3 <> 0),
n AS (SELECT doc, count(*) AS n FROM p GROUP BY doc),
s AS (SELECT DISTINCT t.doc, unnest(range(lo, hi + 1)) AS page FROM t JOIN n USING (doc) WHERE o_orderstatus <> 'P' AND t.doc % 5 > 0 AND hi <= n),
c AS (SELECT doc, count(*) AS told FROM s GROUP BY doc),
m AS (SELECT p.*, n.n, s.page IS NOT NULL AS told, EXISTS (SELECT 1 FROM t WHERE t.doc = p.doc) AND coalesce(c.told, 0) >= greatest(10, n.n // 10) AS guided FROM p JOIN n USING (doc) LEFT JOIN s ON s.doc = p.doc AND s.page = p.page LEFT JOIN c ON c.doc = p.doc),
w AS (SELECT *, CASE WHEN guided THEN told AND class IN ('body', 'unknown', 'title') ELSE class = 'body' OR (class IN ('unknown', 'title') AND dense) END AS wanted FROM m),
o AS (SELECT *, bool_or(wanted) OVER (PARTITION BY doc) AS any_ FROM w)
SELECT doc, page, CASE WHEN NOT any_ THEN 'middle' WHEN guided THEN 'contents' ELSE 'body' END AS method,
  CASE WHEN any_ THEN wanted ELSE page BETWEEN greatest(1, n // 10) AND greatest(greatest(1, n // 10), n * 9 // 10) END AS kept FROM o
"""


def _assembly_sql(repairs: int) -> str:
    parts = ["""WITH c AS (SELECT p_brand AS topic, p_partkey AS candidate, list_sort(list_distinct(string_split(p_name || ' ' || p_type, ' '))) AS ws, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part),
s AS (SELECT l_orderkey AS paper, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS slot, p_brand AS topic FROM lineitem JOIN part ON l_partkey = p_partkey),
f0 AS MATERIALIZED (SELECT x.*, candidate, ws, CAST(0 AS BIGINT) AS round FROM (SELECT *, row_number() OVER (PARTITION BY paper, topic ORDER BY slot) AS rank FROM s) x LEFT JOIN c USING (topic, rank))"""]
    for k in range(repairs):
        parts.append(f"""g{k} AS MATERIALIZED (SELECT DISTINCT b.paper, b.slot FROM f{k} a JOIN f{k} b ON a.paper = b.paper AND a.slot < b.slot AND len(list_intersect(a.ws, b.ws)) * 10 > 8 * greatest(len(a.ws), len(b.ws))),
h{k} AS (SELECT f.*, g.slot IS NOT NULL AS again, max(rank) OVER (PARTITION BY f.paper, topic) AS had FROM f{k} f LEFT JOIN g{k} g ON f.paper = g.paper AND f.slot = g.slot),
f{k + 1} AS MATERIALIZED (SELECT paper, slot, topic, rank, candidate, ws, round FROM h{k} WHERE NOT again
  UNION ALL SELECT x.paper, x.slot, topic, rank, c.candidate, c.ws, {k + 1} FROM (SELECT paper, slot, topic, had + row_number() OVER (PARTITION BY paper, topic ORDER BY slot) AS rank FROM h{k} WHERE again) x LEFT JOIN c USING (topic, rank))""")
    return ",\n".join(parts) + f"\nSELECT paper, CAST(slot AS INT) AS slot, topic, rank, candidate, round FROM f{repairs}"


ORACLE_SQL["paper_assembly"] = _assembly_sql(2)

ORACLE_SQL["domain_gate"] = r"""
WITH t AS (SELECT conv_id, turn, conv_id % 4 AS subject, coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN ' See ECU.' ELSE '' END AS q, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS e, role FROM conversations),
i AS (SELECT item_id % 3 AS subject, regexp_extract_all(lower(text), '[\p{L}]{4,}') AS ws, regexp_extract_all(lower(text), '[\p{L}]+ [\p{L}]+') AS two FROM benchmark),
permitted AS (SELECT DISTINCT subject, unnest(ws[5:7]) AS term FROM i),
foreign_ AS (SELECT DISTINCT subject, unnest(ws[1:6]) AS term FROM i),
phrases AS (SELECT DISTINCT unnest(list_concat(two, ws[8:10])) AS term FROM i),
g AS (SELECT t.*, ' ' || array_to_string(regexp_split_to_array(q, '[^\p{L}\p{N}_]+'), '  ') || ' ' AS qs, list_concat([lower(role)], CASE WHEN conv_id % 2 = 0 THEN ['the ecu', 'the', 'ecu'] ELSE [] END,
    list_filter(regexp_split_to_array(lower(e), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{4,}')), coalesce((SELECT list(term) FROM permitted p WHERE p.subject = t.subject), []),
    CASE WHEN t.subject < 3 THEN ['vehicle', 'technician', 'student', 'case', 'scenario', 'study', 'explain', 'describe', 'analyse', 'illustrate', 'binary', 'tree'] ELSE [] END) AS ok FROM t),
met AS MATERIALIZED (SELECT conv_id, turn, q, ok, term FROM g JOIN phrases ON contains(lower(q), term)),
few AS MATERIALIZED (SELECT * FROM met WHERE length(term) >= 3 AND contains(q, upper(term[1]) ) AND NOT list_contains(ok, term)),
bad AS (
  SELECT conv_id, turn, unnest(list_transform(list_filter(regexp_split_to_array(q, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{3,5}') AND NOT list_contains(ok, lower(w)) AND lower(w) NOT IN ('case', 'study', 'tree')), lambda w: lower(w))) AS term FROM g
  UNION SELECT conv_id, turn, term FROM g JOIN foreign_ f ON f.subject = g.subject AND contains(lower(qs), ' ' || term || ' ') AND NOT list_contains(ok, term)
  UNION SELECT conv_id, turn, term FROM few WHERE term NOT IN ('vehicle', 'technician', 'student', 'case', 'scenario', 'study', 'explain', 'describe', 'analyse', 'illustrate', 'binary', 'tree')
    AND len(list_filter(string_split(term, ' '), lambda w: length(w) >= 4 AND w NOT IN ('with', 'from', 'that', 'this', 'case', 'study'))) > 0
    AND len(list_filter(string_split(term, ' '), lambda w: length(w) >= 4 AND w NOT IN ('with', 'from', 'that', 'this', 'case', 'study') AND list_contains(ok, w))) = 0
    AND regexp_matches(q, '(^|[^\p{L}\p{N}_])' || upper(term[1]) || '(?i:' || term[2:] || ')($|[^\p{L}\p{N}_])')),
u AS (SELECT conv_id, turn, list_sort(list(DISTINCT term)) AS terms FROM bad GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(array_to_string(terms, ','), '') AS unseen, terms IS NULL AS passed, CASE WHEN terms IS NULL THEN 1.0::DOUBLE ELSE round(greatest(0.2::DOUBLE, 1 - len(terms) * 0.25::DOUBLE), 2) END AS score FROM t LEFT JOIN u USING (conv_id, turn)
"""


def retrieval_grounded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as queries, every other one of a module; documents are chunks, their language the module."""
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text", F.when(F.col("item_id") % 2 == 0, "en").alias("module"))
    chunks = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("module"))
    return search.grounded(queries, chunks, 3).select(F.col("q_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def retrieval_concepts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as queries, every seventh blank; documents are concepts named by their first line."""
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.when(F.col("item_id") % 7 == 6, " ").otherwise(F.col("text")).alias("text"))
    known = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"^[^\n]*", 0).alias("name"), "text", (F.col("doc_id") % 11 / 10).alias("confidence"), F.col("lang").alias("kind"))
    return search.concepts(queries, known, 5).select(F.col("q_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 3).alias("score"), "rank")


QUERIES |= {f.__name__: f for f in (retrieval_grounded_topk, retrieval_concepts_topk)}

_VOCABULARY = ", ".join(f"'{w}'" for w in dict.fromkeys(CHUNK_VOCABULARY))
ORACLE_SQL["retrieval_grounded_topk"] = rf"""
WITH q AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'en' END AS module, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS ts FROM benchmark),
d AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS low, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS ts FROM documents),
s AS (SELECT doc_id, lang, ts, len(list_filter([{_VOCABULARY}], lambda w: contains(low, w))) AS hits, len(regexp_extract_all(low, '\S+')) AS n FROM d),
t AS MATERIALIZED (SELECT doc_id, lang, ts, 0.3::DOUBLE * least(1::DOUBLE, hits / 8.0::DOUBLE) + 0.2::DOUBLE * CASE WHEN n BETWEEN 80 AND 400 THEN 1 WHEN n < 80 THEN n / 80.0::DOUBLE ELSE greatest(0.5::DOUBLE, 400.0::DOUBLE / n) END AS fixed FROM s),
b AS (SELECT item_id, doc_id, module, lang, floor((0.5::DOUBLE * len(list_intersect(q.ts, t.ts)) / greatest(1, len(q.ts)) + fixed) * 10000 + 0.500001::DOUBLE) / 10000 AS base FROM q, t),
r AS (SELECT item_id, doc_id, round(CASE WHEN module = lang THEN least(1::DOUBLE, base + 0.15::DOUBLE) WHEN module <> lang THEN base * 0.6::DOUBLE ELSE base END, 6) AS score FROM b)
SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r QUALIFY rank <= 3
"""

ORACLE_SQL["retrieval_concepts_topk"] = r"""
WITH d AS (SELECT doc_id, lower(regexp_extract(coalesce(text, ''), '^[^\n]*')) AS name, doc_id % 11 / 10.0::DOUBLE AS conf, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
e AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d), c AS MATERIALIZED (SELECT doc_id, term, count(*) / CAST(max(n) AS DOUBLE) AS tf FROM e GROUP BY doc_id, term),
idf AS MATERIALIZED (SELECT term, ln(((SELECT count(*) FROM d) + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1 AS idf FROM c GROUP BY term),
q AS (SELECT item_id, CASE WHEN item_id % 7 = 6 THEN ' ' ELSE text END AS text FROM benchmark), qe AS (SELECT item_id, len(ws) AS n, unnest(ws) AS term FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM q)),
qw AS MATERIALIZED (SELECT item_id, term, count(*) / CAST(max(n) AS DOUBLE) * coalesce(max(idf), ln((SELECT count(*) FROM d) + 1)) AS w FROM qe LEFT JOIN idf USING (term) GROUP BY item_id, term),
dw AS MATERIALIZED (SELECT doc_id, term, tf * idf AS w FROM c JOIN idf USING (term)),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY item_id), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
cos AS (SELECT item_id, doc_id, sum(qw.w * dw.w) / max(qn.norm * dn.norm) AS s FROM qw JOIN dw USING (term) JOIN qn USING (item_id) JOIN dn USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT q.item_id, d.doc_id, 0.7::DOUBLE * coalesce(s, 0) + 0.3::DOUBLE * conf AS x, conf, trim(q.text) = '' AS blank,
  EXISTS (SELECT 1 FROM qw WHERE qw.item_id = q.item_id AND length(term) > 3 AND contains(name, term)) AS named FROM q CROSS JOIN d LEFT JOIN cos ON cos.item_id = q.item_id AND cos.doc_id = d.doc_id),
f AS (SELECT item_id, doc_id, round(CASE WHEN blank THEN conf WHEN named THEN least(1::DOUBLE, x + 0.15::DOUBLE) ELSE x END, 9) AS score FROM r)
SELECT item_id, doc_id, round(score, 3) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 5
"""


def _packed(spark: SparkSession, sf_dir: str, packs) -> DataFrame:
    """Chunks of all documents; a line is a paragraph, as these texts have no blank lines."""
    made = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(packs(F.col("text"))).alias("place", "chunk"))
    return made.select("doc_id", "place", packers.words(F.col("chunk")).cast("long").alias("n_words"), F.md5("chunk").alias("chunk"))


def doc_paragraph_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, lambda t: packers.paragraph_packs(t, at=r"\n"))


def doc_concept_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, lambda t: packers.concept_packs(t, at=r"\n"))


def doc_module_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, lambda t: packers.module_packs(t, at=r"\n"))


def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = questions.parse(_read(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return made.select("doc_id", "place", "question_id", F.md5("question").alias("question"), "parser", "marks", "level", "kind", "difficulty")


QUERIES |= {f.__name__: f for f in (doc_paragraph_packs, doc_concept_packs, doc_module_packs, parsed_questions)}

ORACLE_SQL["doc_paragraph_packs"] = r"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents),
l AS (SELECT doc_id, k, ps[k] AS t, len(regexp_extract_all(ps[k], '\S+')) AS n FROM p, unnest(range(1, len(ps) + 1)) AS r(k)),
go AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS made, CAST([] AS VARCHAR[]) AS cur, CAST(0 AS BIGINT) AS n FROM p
  UNION ALL
  SELECT l.doc_id, l.k,
    CASE WHEN l.n >= 80 THEN list_append(CASE WHEN go.n >= 80 THEN list_append(made, array_to_string(cur, chr(10))) ELSE made END, t) WHEN go.n + l.n >= 400 THEN list_append(made, array_to_string(list_append(cur, t), chr(10))) ELSE made END,
    CASE WHEN l.n >= 80 THEN CASE WHEN go.n >= 80 THEN [] ELSE cur END WHEN go.n + l.n >= 400 THEN [] ELSE list_append(cur, t) END,
    CASE WHEN l.n >= 80 THEN CASE WHEN go.n >= 80 THEN 0 ELSE go.n END WHEN go.n + l.n >= 400 THEN 0 ELSE go.n + l.n END
  FROM go JOIN l ON l.doc_id = go.doc_id AND l.k = go.k + 1),
e AS (SELECT doc_id, arg_max(CASE WHEN n >= 80 THEN list_append(made, array_to_string(cur, chr(10))) ELSE made END, k) AS cs FROM go GROUP BY doc_id)
SELECT doc_id, CAST(i - 1 AS INT) AS place, len(regexp_extract_all(cs[i], '\S+')) AS n_words, md5(cs[i]) AS chunk FROM e, unnest(range(1, len(cs) + 1)) AS r(i)
"""


def _signs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, some with a code at the end; five classes; items give each class words and, every third one, a phrase."""
    code = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit(" C"), F.col("doc_id") % 7)).otherwise("")
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), code).alias("text"), F.col("lang").alias("contents"), "source")
    classes = _read(spark, sf_dir, "benchmark").select(F.concat(F.lit("C"), F.col("item_id") % 5).alias("class"), (F.col("item_id") % 5).cast("int").alias("place")).distinct()
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{4,}"), F.lit(0)), 1, 6)
    phrase = F.when(F.col("item_id") % 3 == 0, F.array(F.regexp_extract(F.lower("text"), r"[\p{L}]+ [\p{L}]+", 0))).otherwise(F.array().cast("array<string>"))
    terms = _read(spark, sf_dir, "benchmark").select(F.concat(F.lit("C"), F.col("item_id") % 5).alias("class"), F.explode(F.concat(words, phrase)).alias("term"))
    return docs, classes, terms


def subject_by_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, classes, terms = _signs(spark, sf_dir)
    made = classify.subjects(docs, classes, terms, r"\bC[0-9]\b")
    return made.select(F.col("id").alias("doc_id"), "subject", "confidence", "confirm", "second")


def subject_by_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, classes, terms = _signs(spark, sf_dir)
    return classify.voted(docs, classes, terms.distinct(), "none").withColumnRenamed("id", "doc_id")


def material_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, classes, terms = _signs(spark, sf_dir)
    weighed = terms.distinct().select("class", "term", (F.lit(0.1) + F.length("term") % 3 * 0.05).alias("weight"), F.lit(False).alias("in_name"))
    named = classes.select("class", F.concat(F.lit("s"), F.col("place")).alias("term"), F.lit(0.5).alias("weight"), F.lit(True).alias("in_name"))
    return classify.materials(docs.withColumnRenamed("source", "name"), classes, weighed.union(named)).withColumnRenamed("id", "doc_id")


KINDS = {"table": [r"\|", r"\t"], "prose": [r"\. [A-Z]", r"[a-z]{12,}", r","], "code": ["=", r"\{", r";"]}


def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("name"))
    return classify.kinds(docs, KINDS, {"code": ["1", "2"], "table": ["3"]}).select(F.col("id").alias("doc_id"), "kind", F.round("p", 9).alias("p"))


QUERIES |= {f.__name__: f for f in (subject_by_terms, subject_by_votes, material_shares, document_kinds)}

_SIGNS = r"""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN ' C' || (doc_id % 7) ELSE '' END AS text FROM documents),
b AS (SELECT item_id, item_id % 5 AS place, regexp_extract_all(lower(text), '[\p{L}]{4,}')[1:6] AS ws, regexp_extract(lower(text), '[\p{L}]+ [\p{L}]+') AS phrase FROM benchmark),
t AS MATERIALIZED (SELECT DISTINCT place, term FROM (SELECT place, unnest(CASE WHEN item_id % 3 = 0 THEN list_append(ws, phrase) ELSE ws END) AS term FROM b) WHERE term <> '')"""

ORACLE_SQL["subject_by_terms"] = _SIGNS + r""",
n AS (SELECT place, count(*) AS n FROM t GROUP BY place),
h AS (SELECT doc_id, place, count(*) AS hits FROM d JOIN t ON contains(lower(concat_ws(chr(10), text, lang)), term) GROUP BY doc_id, place),
r AS (SELECT doc_id, place, hits / CAST(n AS DOUBLE) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY hits / CAST(n AS DOUBLE) DESC, place) AS k FROM h JOIN n USING (place)),
x AS (SELECT doc_id, max(s) FILTER (k = 1) AS s1, coalesce(max(s) FILTER (k = 2), 0) AS s2, max(place) FILTER (k = 1) AS p1, max(place) FILTER (k = 2) AS p2 FROM r GROUP BY doc_id),
c AS (SELECT doc_id, list_filter(regexp_extract_all(text, '\bC[0-9]\b'), lambda x: x IN ('C0', 'C1', 'C2', 'C3', 'C4'))[1] AS coded FROM d)
SELECT doc_id, coalesce(coded, 'C' || p1) AS subject, round(CASE WHEN coded IS NOT NULL THEN 0.99 WHEN s1 IS NULL THEN 0 ELSE least(0.98::DOUBLE, s1 * 1.5::DOUBLE) END, 4) AS confidence,
  coded IS NULL AND coalesce(least(0.98::DOUBLE, s1 * 1.5::DOUBLE) < 0.9::DOUBLE OR s1 - s2 < 0.1::DOUBLE, true) AS confirm, CASE WHEN coded IS NULL THEN 'C' || p2 END AS second
FROM c LEFT JOIN x USING (doc_id)
"""

ORACLE_SQL["subject_by_votes"] = _SIGNS + r""",
w AS (SELECT doc_id, lower(text) AS low, regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+') AS ws FROM d),
v AS (SELECT doc_id, place, sum(CASE WHEN contains(term, ' ') THEN 2 ELSE 1 END) AS v FROM w JOIN t ON CASE WHEN contains(term, ' ') THEN contains(low, term) ELSE list_contains(ws, term) END GROUP BY doc_id, place)
SELECT doc_id, coalesce('C' || arg_max(place, v * 100 - place), 'none') AS subject, CAST(coalesce(max(v), 0) AS BIGINT) AS votes FROM d LEFT JOIN v USING (doc_id) GROUP BY doc_id
"""

ORACLE_SQL["material_shares"] = _SIGNS + r""",
s AS (SELECT doc_id, place, 0.1 + length(term) % 3 * 0.05 AS w FROM d JOIN t ON contains(lower(concat_ws(chr(10), source, text)), term)
  UNION ALL SELECT doc_id, p, 0.5 FROM d, range(5) AS r(p) WHERE contains(lower(coalesce(source, '')), 's' || p) AND p IN (SELECT place FROM b)),
e AS (SELECT doc_id, place, sum(w) AS w FROM s GROUP BY doc_id, place),
x AS (SELECT doc_id, arg_max(place, w * 1000 - place * 0.001) AS p, CAST(max(w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS share FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN share >= 0.3::DOUBLE THEN 'C' || p ELSE 'unknown' END AS material, round(coalesce(share, 0) + 1e-9::DOUBLE, 3) AS confidence FROM d LEFT JOIN x USING (doc_id)
"""

ORACLE_SQL["document_kinds"] = r"""
WITH s AS (SELECT doc_id, coalesce(source, '') AS name, CAST(regexp_matches(coalesce(text, ''), '\|') AS INT) + CAST(regexp_matches(coalesce(text, ''), '\t') AS INT) AS a,
  CAST(regexp_matches(coalesce(text, ''), '\. [A-Z]') AS INT) + CAST(regexp_matches(coalesce(text, ''), '[a-z]{12,}') AS INT) + CAST(contains(coalesce(text, ''), ',') AS INT) AS b,
  CAST(contains(coalesce(text, ''), '=') AS INT) + CAST(contains(coalesce(text, ''), '{') AS INT) + CAST(contains(coalesce(text, ''), ';') AS INT) AS c FROM documents),
p AS (SELECT doc_id, unnest(['table', 'prose', 'code']) AS kind, unnest([CASE WHEN contains(name, '3') THEN least(1::DOUBLE, a / 2.0::DOUBLE + 0.1::DOUBLE) ELSE a / 2.0::DOUBLE END, b / 3.0::DOUBLE,
  CASE WHEN contains(name, '1') OR contains(name, '2') THEN least(1::DOUBLE, c / 3.0::DOUBLE + 0.1::DOUBLE) ELSE c / 3.0::DOUBLE END]) AS s FROM s)
SELECT doc_id, kind, round(exp(s) / sum(exp(s)) OVER (PARTITION BY doc_id), 9) AS p FROM p
"""


def doc_removed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cleaners.preprocess(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("doc_id", F.array_join("headers", "|").alias("headers"), F.size("contents").cast("long").alias("contents"), "confidence")


def doc_prepared_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cleaners.preprocess(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("doc_id", F.posexplode("sections").alias("place", "s")).select("doc_id", "place", "s.title", F.md5("s.content").alias("content"), cleaners.n_words(F.col("s.content")).alias("n_words"))


QUERIES |= {f.__name__: f for f in (doc_removed_lines, doc_prepared_sections)}

ORACLE_SQL["doc_removed_lines"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
c AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls FROM d),
l AS (SELECT doc_id, i, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS s FROM c, unnest(range(1, len(ls) + 1)) AS r(i)),
r AS (SELECT doc_id, lower(s) AS low FROM l WHERE length(s) BETWEEN 4 AND 120 AND NOT regexp_full_match(s, '\d+') GROUP BY doc_id, lower(s) HAVING count(*) >= 3),
m AS (SELECT l.*, s <> '' AND (r.low IS NOT NULL OR regexp_full_match(lower(s), '(page\s+\d+(\s+of\s+\d+)?|(isbn|copyright|all rights reserved|published by|doi:).*|https?://\S+|[-=_]{4,}|\d+)')) AS header,
  regexp_matches(s, '.{10,}\.{3,}\s*\d+\s*$') OR (regexp_full_match(s, '\d+(\.\d+)*\s+[A-Z].*\s+\d+') AND length(s) - length(replace(s, '.', '')) >= 2) AS toc FROM l LEFT JOIN r ON r.doc_id = l.doc_id AND r.low = lower(s)),
t AS (SELECT doc_id, string_agg(s, '|' ORDER BY i) FILTER (header) AS headers, count(*) FILTER (header) AS nh, count(*) FILTER (NOT header AND toc) AS contents, count(*) AS n FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(headers, '') AS headers, coalesce(contents, 0) AS contents, round(least(0.98::DOUBLE, greatest(0.5::DOUBLE, 1 - coalesce(nh + contents, 0) / CAST(greatest(coalesce(n, 0), 1) AS DOUBLE) * 0.5::DOUBLE)), 2) AS confidence
FROM d LEFT JOIN t USING (doc_id)
"""
