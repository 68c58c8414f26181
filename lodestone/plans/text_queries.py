"""Queries over texts, pages, conversations, embeddings and event time, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import text as T
from ..operators import dedup, retrieve, segment

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _hits(words, text="low") -> str:
    return " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in dict.fromkeys(words))


def _n(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


CHUNK_SQL = rf"""
cb AS (SELECT *, trim(coalesce(text, '')) AS t FROM src),
cw AS (SELECT *, lower(t) AS low, regexp_extract_all(t, '[^\s\x0b]+') AS ws FROM cb),
m AS (SELECT *, CAST(len(ws) AS INT) AS word_count, {_n(r"[\p{L}\p{N}\p{P}\p{Z}]")} / greatest(length(t), 1) AS printable,
        len(list_filter(ws, lambda x: regexp_matches(x, '^[\p{{L}}][\p{{L}}''-]*[\p{{P}}]?$'))) / greatest(len(ws), 1) AS density,
        {_hits(T.CHUNK_VOCABULARY)} AS academic FROM cw),
q AS (SELECT *, round(least(1, 0.40::DOUBLE * printable + 0.35::DOUBLE * density + 0.25::DOUBLE * least(1, academic / 10)
        + CASE WHEN word_count BETWEEN 50 AND 400 THEN 0.05::DOUBLE ELSE 0 END), 4) AS quality FROM m),
scored AS (SELECT *, CASE WHEN t = '' THEN 'EMPTY'
        WHEN {" OR ".join(f"regexp_matches(t, '{p}')" for p in T.CORRUPTION).replace("-\\x9f", "-\\x{9f}")} THEN 'CORRUPTION'
        WHEN printable < 0.85 THEN 'LOW_PRINTABLE' WHEN word_count < 25 THEN 'TOO_SHORT' WHEN density < 0.60 THEN 'LOW_WORD_DENSITY'
        WHEN academic < 2 THEN 'LOW_ACADEMIC' WHEN quality < 0.70 THEN 'LOW_QUALITY' ELSE '' END AS reason FROM q)
"""


@_query(f"WITH src AS (SELECT doc_id, text FROM documents), {CHUNK_SQL} SELECT doc_id, word_count, round(printable, 4) AS printable, round(density, 4) AS density, academic, quality, reason FROM scored")
def doc_quality_scores(spark, sf_dir):
    made = quality.chunk_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "word_count", F.round("printable", 4).alias("printable"), F.round("density", 4).alias("density"), "academic", "quality", "reason")


@_query(
    rf"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(lower(t), '\b[a-z]{{2,}}\b') AS ws, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM b),
s AS (SELECT doc_id, t,
  CASE WHEN len(ws) = 0 THEN 0 ELSE least(1, len(list_filter(ws, lambda x: x IN ({", ".join(repr(w) for w in T.ACADEMIC_TERMS)}))) / len(ws) * 15) END AS language,
  least(1, ({_n(r"[=+\-*/^√∫∑∏α-ωΑ-Ω∈∉⊂⊃⊆⊇]")} * 2 + {_n(r"\\(frac|sum|int|sqrt|alpha|beta|theta|partial)")} * 4 + {_n(r"\b[0-9]+(\.[0-9]+)?\b")} * 0.5::DOUBLE) / (length(t) / 100.0::DOUBLE + 1)) AS formula,
  CASE WHEN len(ls) = 0 THEN 0 ELSE len(list_filter(ls, lambda x: regexp_matches(x, '\||\t|\s{{3,}}'))) / len(ls) END AS tabular,
  least(1, {_n(r"(?i)\b(fig|figure|block diagram|circuit|schematic|architecture)\b")} * 0.33::DOUBLE) AS diagram,
  least(1, ({" + ".join(_n(p) for p in T.CLUTTER)}) * 0.2::DOUBLE + {_n(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")} / greatest(length(t), 1)) AS noise,
  {_n(r"[\p{L}\p{N}\p{P}\p{Z}]")} / greatest(length(t), 1) AS ocr FROM w),
e AS (SELECT *, length(regexp_replace(t, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) >= 20 AS enough FROM s),
f AS (SELECT doc_id, t, enough, CASE WHEN enough THEN language ELSE 0 END AS language, CASE WHEN enough THEN formula ELSE 0 END AS formula, CASE WHEN enough THEN tabular ELSE 0 END AS tabular,
  CASE WHEN enough THEN diagram ELSE 0 END AS diagram, CASE WHEN enough THEN noise ELSE 1 END AS noise, CASE WHEN enough THEN ocr ELSE 0 END AS ocr FROM e)
SELECT doc_id, round(language, 4) AS language, round(formula, 4) AS formula, round(tabular, 4) AS tabular, round(diagram, 4) AS diagram, round(noise, 4) AS noise,
  round(ocr, 4) AS ocr, round(least(1, language * 0.4::DOUBLE + ocr * 0.3::DOUBLE + formula * 0.2::DOUBLE + diagram * 0.1::DOUBLE), 4) AS overall,
  ocr >= 0.7 AND noise <= 0.4 AND enough AS valid FROM f"""
)
def doc_academic_score(spark, sf_dir):
    made = quality.academic_quality(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.drop("text")


LINES_SQL = "lines AS (SELECT doc_id, i - 1 AS line_no, trim(string_split(coalesce(text, ''), chr(10))[i]) AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(i)), kept AS (SELECT * FROM lines WHERE line <> '')"


@_query(f"WITH {LINES_SQL} SELECT doc_id, lower(line) AS line, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) >= 3")
def doc_repeated_lines(spark, sf_dir):
    return segment.repeated_lines(segment.lines(_read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "line", 3)


@_query(
    rf"""
WITH {LINES_SQL},
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(line)) AS times FROM kept),
j AS (SELECT doc_id, line_no, length(line) < 2 OR regexp_matches(line, '^[0-9]+$') OR regexp_matches(line, '^(---|===|___)') OR regexp_matches(line, '^https?://[^ ]+$')
   OR regexp_matches(line, '(?i)^(isbn|copyright|all rights reserved|published by)\b') OR (times >= 8 AND length(line) >= 4) AS junk FROM c)
SELECT doc_id, count(*) AS original_lines, count(*) FILTER (WHERE junk) AS removed_lines FROM j GROUP BY doc_id"""
)
def doc_line_clean(spark, sf_dir):
    rows = segment.lines(_read(spark, sf_dir, "documents"), "doc_id", "text")
    times = rows.groupBy("doc_id", F.lower("line").alias("_l")).agg(F.count("*").alias("times"))
    joined = rows.withColumn("_l", F.lower("line")).join(times, ["doc_id", "_l"])
    line = F.col("line")
    junk = (F.length(line) < 2) | line.rlike(r"^[0-9]+$") | line.rlike(r"^(---|===|___)") | line.rlike(r"^https?://[^ ]+$")
    junk = junk | line.rlike(r"(?i)^(isbn|copyright|all rights reserved|published by)\b") | ((F.col("times") >= 8) & (F.length(line) >= 4))
    return joined.groupBy("doc_id").agg(F.count("*").alias("original_lines"), F.count_if(junk).alias("removed_lines"))


@_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(lower(trim(coalesce(text, ''))))")
def doc_exact_dedup(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.groupBy(dedup.content_hash(F.col("text")).alias("_k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("_k")


@_query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY substr(lower(trim(coalesce(text, ''))), 1, 80) ORDER BY doc_id) = 1")
def doc_prefix_dedup(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.substring(F.lower(F.trim(F.coalesce("text", F.lit("")))), 1, 80).alias("p"))
    return dedup.first_by(docs, F.col("p"), "doc_id").drop("p")


CHUNKS_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\s\x0b]+') AS ws FROM documents),
c AS (SELECT doc_id, CAST(i / {step} AS INT) AS chunk_no, array_to_string(ws[i + 1 : i + {size}], ' ') AS chunk FROM w, unnest(range(0, len(ws), {step})) AS r(i)),
chunks AS (SELECT * FROM c WHERE length(chunk) >= 50)"""


@_query("WITH " + CHUNKS_SQL.format(step=270, size=300) + " SELECT doc_id, chunk_no, md5(chunk) AS chunk_hash, length(chunk) AS chars FROM chunks")
def doc_word_chunks(spark, sf_dir):
    made = segment.word_chunks(_read(spark, sf_dir, "documents"), "doc_id", "text", 300, 30)
    return made.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_hash"), F.length("chunk").cast("long").alias("chars"))


@_query("WITH " + CHUNKS_SQL.format(step=300, size=300) + " SELECT doc_id, count(*) AS chunks, max(length(chunk)) AS longest FROM chunks GROUP BY doc_id")
def doc_fixed_chunks(spark, sf_dir):
    made = segment.word_chunks(_read(spark, sf_dir, "documents"), "doc_id", "text", 300, 0)
    return made.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).cast("long").alias("longest"))


HEAD = "length(line) <= 60"


@_query(f"WITH {LINES_SQL}, s AS (SELECT *, CAST(sum(CAST({HEAD} AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS segment FROM kept) SELECT doc_id, segment, count(*) AS lines FROM s WHERE segment > 0 GROUP BY ALL")
def doc_heading_segments(spark, sf_dir):
    rows = segment.lines(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return segment.segments(rows, "doc_id", "line_no", F.expr(HEAD)).groupBy("doc_id", "segment").agg(F.count("*").alias("lines"))


@_query(
    f"WITH {LINES_SQL}, t AS (SELECT *, coalesce(last_value(CASE WHEN {HEAD} THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'General') AS topic FROM kept) SELECT doc_id, topic, count(*) AS lines FROM t GROUP BY ALL"
)
def topic_carry_forward(spark, sf_dir):
    rows = segment.lines(_read(spark, sf_dir, "documents"), "doc_id", "text")
    made = segment.carry_forward(rows, "doc_id", "line_no", F.when(F.expr(HEAD), F.col("line")), "General")
    return made.groupBy("doc_id", "topic").agg(F.count("*").alias("lines"))


def _bloom_sql(levels, default) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {v!r})' for v in signs)} THEN '{x}'" for x, signs in levels.items()) + f" ELSE '{default}' END"


ASCENDING, DESCENDING = _bloom_sql(T.VERBS, "L2"), _bloom_sql(T.NAMED_LEVELS, "understand")


@_query(f"WITH b AS (SELECT role, lower(coalesce(text, '')) AS low FROM conversations) SELECT role, {ASCENDING} AS ascending, {DESCENDING} AS descending, count(*) AS n FROM b GROUP BY ALL")
def bloom_level_distribution(spark, sf_dir):
    text = F.col("text")
    return _read(spark, sf_dir, "conversations").groupBy("role", T.bloom_ascending(text).alias("ascending"), T.bloom_descending(text).alias("descending")).agg(F.count("*").alias("n"))


def _marks_sql(p: str) -> str:
    n = f"TRY_CAST(nullif(regexp_extract(text, '{p}', 1), '') AS INT)"
    return f"CASE WHEN {n} BETWEEN 1 AND 20 THEN {n} END"


_COSTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.LEVEL_COST.items())


@_query(
    rf"""WITH m AS (SELECT doc_id, lower(coalesce(text, '')) AS low, coalesce({", ".join(map(_marks_sql, T.MARKS))}) AS marks FROM documents),
b AS (SELECT doc_id, marks, {DESCENDING} AS bloom FROM m),
s AS (SELECT *, CASE bloom {_COSTS} END + coalesce(CAST(marks > 8 AS INT), 0) + coalesce(CAST(marks > 12 AS INT), 0) AS score FROM b)
SELECT doc_id, marks, bloom, CASE WHEN score <= 2 THEN 'easy' WHEN score <= 4 THEN 'medium' ELSE 'hard' END AS difficulty FROM s"""
)
def question_marks_difficulty(spark, sf_dir):
    made = _read(spark, sf_dir, "documents").select("doc_id", T.marks(F.col("text")).alias("marks"), T.bloom_descending(F.col("text")).alias("bloom"))
    return made.withColumn("difficulty", T.difficulty(F.col("bloom"), F.col("marks")))


TOKENS_SQL = r"tk AS (SELECT {key} AS k, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 2)) AS token FROM {table})"


@_query(
    r"""WITH t AS (SELECT role, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2)) AS token FROM conversations),
c AS (SELECT role, token, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT role, sqrt(sum(n * n)) AS size FROM c GROUP BY role)
SELECT a.role AS role_a, b.role AS role_b, round(sum(a.n * b.n) / max(x.size * y.size), 6) AS cosine FROM c a JOIN c b ON a.token = b.token AND a.role < b.role
JOIN s x ON x.role = a.role JOIN s y ON y.role = b.role GROUP BY a.role, b.role"""
)
def style_cosine(spark, sf_dir):
    c = retrieve.token_table(_read(spark, sf_dir, "conversations"), "role", "text")
    size = c.groupBy("role").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    a = c.select(F.col("role").alias("role_a"), "token", F.col("n").alias("x")).join(size.select(F.col("role").alias("role_a"), F.col("size").alias("sa")), "role_a")
    b = c.select(F.col("role").alias("role_b"), "token", F.col("n").alias("y")).join(size.select(F.col("role").alias("role_b"), F.col("size").alias("sb")), "role_b")
    met = a.join(b, "token").where("role_a < role_b")
    return met.groupBy("role_a", "role_b").agg(F.round(F.sum(F.col("x") * F.col("y")) / F.max(F.col("sa") * F.col("sb")), 6).alias("cosine"))


BOTH_SQL = r"""q AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2)) AS token FROM benchmark),
d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2)) AS token FROM documents),
qt AS (SELECT item_id, token, count(*) AS n FROM q GROUP BY ALL), dt AS (SELECT doc_id, token, count(*) AS n FROM d GROUP BY ALL)"""


def _both(spark, sf_dir):
    return retrieve.token_table(_read(spark, sf_dir, "benchmark"), "item_id", "text"), retrieve.token_table(_read(spark, sf_dir, "documents"), "doc_id", "text")


@_query(
    f"""WITH {BOTH_SQL}, z AS (SELECT item_id, count(*) AS size FROM qt GROUP BY item_id),
s AS (SELECT qt.item_id, dt.doc_id, round(count(*) / max(z.size), 4) AS score FROM qt JOIN dt USING (token) JOIN z USING (item_id) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 3"""
)
def retrieval_lexical_topk(spark, sf_dir):
    return retrieve.lexical(*_both(spark, sf_dir), "item_id", "doc_id", 3)


@_query(
    f"""WITH {BOTH_SQL}, nd AS (SELECT count(DISTINCT doc_id) AS n_docs FROM dt),
idf AS (SELECT token, ln((max(n_docs) + 1) / (count(*) + 1)) + 1 AS idf FROM dt, nd GROUP BY token),
qw AS (SELECT item_id, token, n * idf AS w FROM qt JOIN idf USING (token)), dw AS (SELECT doc_id, token, n * idf AS w FROM dt JOIN idf USING (token)),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY item_id), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
s AS (SELECT qw.item_id, dw.doc_id, round(sum(qw.w / qn.norm * dw.w / dn.norm), 4) AS score FROM qw JOIN dw USING (token) JOIN qn USING (item_id) JOIN dn USING (doc_id) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 3"""
)
def retrieval_tfidf_topk(spark, sf_dir):
    return retrieve.tfidf(*_both(spark, sf_dir), "item_id", "doc_id", 3)


PAIRS_SQL = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM v),
p AS (SELECT q.vec_id AS q_id, q.label AS q_label, d.vec_id, d.label, round(list_dot_product(q.e, d.e) / q.size / d.size, 5) AS sim
  FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)"""


def _top(spark, sf_dir, k, keep=None):
    base = _read(spark, sf_dir, "embeddings")
    return retrieve.vector_top(base.where("vec_id % 50 = 0"), base, k, keep)


@_query(f"WITH {PAIRS_SQL} SELECT q_id, vec_id, sim, CAST(row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) AS INT) AS rank FROM p QUALIFY rank <= 5")
def vector_topk(spark, sf_dir):
    return _top(spark, sf_dir, 5).select("q_id", "vec_id", "sim", "rank")


@_query(f"WITH {PAIRS_SQL} SELECT q_id, vec_id, sim FROM p WHERE label <> q_label AND sim > 0.05 AND sim < 0.9 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) = 1")
def vector_hard_negatives(spark, sf_dir):
    return _top(spark, sf_dir, 1, lambda sim, label, own: (label != own) & (sim > 0.05) & (sim < 0.9)).select("q_id", "vec_id", "sim")


@_query(f"WITH {PAIRS_SQL}, t AS (SELECT q_id, label = q_label AS same FROM p QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) <= 10), h AS (SELECT q_id, bool_or(same) AS hit FROM t GROUP BY q_id) SELECT count(*) AS queries, round(avg(CAST(hit AS INT)), 6) AS recall FROM h")
def recall_at_10(spark, sf_dir):
    top = _top(spark, sf_dir, 10)
    hits = top.groupBy("q_id").agg(F.bool_or(F.col("label") == F.col("q_label")).alias("hit"))
    return hits.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("recall"))


@_query("WITH o AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN md5(coalesce(text, '') || '!') ELSE md5(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 10 <> 5) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h")
def manifest_diff(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    old = docs.where("doc_id % 10 <> 3").select("doc_id", F.md5("t").alias("h"))
    new = docs.where("doc_id % 10 <> 5").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("t", F.lit("!")))).otherwise(F.md5("t")).alias("h"))
    return dedup.manifest_diff(old, new, "doc_id", "h")


@_query("SELECT doc_id, 'existing' AS origin FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, 'new' AS origin FROM documents WHERE doc_id % 3 = 1")
def store_merge_existing_wins(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    existing, new = docs.where("doc_id % 3 <> 1").withColumn("origin", F.lit("existing")), docs.where("doc_id % 3 <> 2").withColumn("origin", F.lit("new"))
    return dedup.merge_existing_wins(existing, new, "doc_id")


@_query("WITH t AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 2)) AS token FROM benchmark), r AS (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY token) AS rn FROM t) SELECT a.token AS anchor, b.token AS positive, count(*) AS n FROM r a JOIN r b ON a.item_id = b.item_id AND b.rn BETWEEN a.rn + 1 AND a.rn + 2 GROUP BY ALL")
def cooccurrence_pairs(spark, sf_dir):
    t = retrieve.token_table(_read(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "token")
    w = Window.partitionBy("item_id").orderBy("token")
    pairs = t.withColumn("next", F.array(F.lead("token", 1).over(w), F.lead("token", 2).over(w)))
    pairs = pairs.select("token", F.explode("next").alias("positive")).where("positive is not null")
    return pairs.groupBy(F.col("token").alias("anchor"), "positive").agg(F.count("*").alias("n"))


@_query(r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS chars FROM pages")
def page_html_extract(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.length(T.strip_tags(F.col("html"))).cast("long").alias("chars"))


@_query(r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS pages, count(DISTINCT url) AS urls, round(avg(length(html)), 4) AS mean_chars FROM pages GROUP BY ALL")
def url_domain_stats(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", r"^https?://([^/]+)", 1))
    return pages.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("url").alias("urls"), F.round(F.avg(F.length("html")), 4).alias("mean_chars"))


_SEC = "date_diff('second', TIMESTAMP '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP))"


def _events(spark, sf_dir):
    return _read(spark, sf_dir, "events").withColumn("at", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"))


@_query(f"SELECT {_SEC} // 21600 * 21600 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf_dir):
    made = _events(spark, sf_dir).groupBy((F.floor(F.col("at") / 21600) * 21600).alias("start"), "event_type")
    return made.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@_query(f"SELECT ({_SEC} // 10800 - k) * 10800 AS start, count(*) AS n FROM events, unnest([0, 1]) AS r(k) GROUP BY ALL")
def event_sliding(spark, sf_dir):
    made = _events(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return made.groupBy(((F.floor(F.col("at") / 10800) - F.col("k")) * 10800).alias("start")).agg(F.count("*").alias("n"))


@_query(
    f"""WITH e AS (SELECT user_id, {_SEC} AS sec FROM events), g AS (SELECT *, CASE WHEN sec - lag(sec) OVER w <= 43200 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT user_id, min(sec) AS start, max(sec) AS stop, count(*) AS n FROM s GROUP BY user_id, session"""
)
def event_session(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("at")
    e = _events(spark, sf_dir).withColumn("new", F.when(F.col("at") - F.lag("at").over(w) <= 43200, 0).otherwise(1))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return e.groupBy("user_id", "session").agg(F.min("at").alias("start"), F.max("at").alias("stop"), F.count("*").alias("n")).drop("session")


@_query(
    "WITH src0 AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(lower(trim(coalesce(text, '')))) ORDER BY doc_id) = 1), "
    + CHUNKS_SQL.format(step=270, size=300).replace("FROM documents", "FROM src0").replace("SELECT doc_id, regexp", "SELECT doc_id, lang, regexp").replace("SELECT doc_id, CAST", "SELECT doc_id, lang, CAST")
    + f", src AS (SELECT doc_id, lang, chunk AS text FROM chunks), {CHUNK_SQL} SELECT lang, count(DISTINCT doc_id) AS docs, count(*) AS chunks, round(avg(quality), 4) AS mean_quality, count(*) FILTER (WHERE reason = '') AS passed FROM scored GROUP BY lang"
)
def corpus_overview(spark, sf_dir):
    """Exact dedup, chunks, chunk quality, and a summary by language."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    unique = dedup.first_by(docs, dedup.content_hash(F.col("text")), "doc_id")
    chunks = segment.word_chunks(unique.withColumn("_key", F.struct("doc_id", "lang")), "_key", "text", 300, 30)
    made = quality.chunk_quality(chunks.select("_key.doc_id", "_key.lang", F.col("chunk").alias("text")))
    return made.groupBy("lang").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("chunks"), F.round(F.avg("quality"), 4).alias("mean_quality"), F.count_if(F.col("reason") == "").alias("passed"))
