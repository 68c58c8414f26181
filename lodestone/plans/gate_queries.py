"""Queries of the gates and packers over conversations and documents, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import quality
from ..functions import text as T
from ..operators import segment
from .text_queries import CHUNK_SQL, CHUNKS_SQL

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


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _any(parts, text: str = "low") -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


#: id columns, raw text x, bare text t, lower-case text low, words ws.
def _base(table: str, ids: str, where: str = "") -> str:
    return rf"""b AS (SELECT {ids}, coalesce(text, '') AS x, lower(coalesce(text, '')) AS low,
  regexp_replace(coalesce(text, ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS t, regexp_extract_all(coalesce(text, ''), '[^\s\x0b]+') AS ws FROM {table} {where})"""


TURNS = "WITH " + _base("conversations", "conv_id, turn")


def _turns(spark, sf_dir, **made):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in made.items()])


@_query(
    rf"""{TURNS}, s AS (SELECT conv_id, turn, 1e0 - CASE WHEN len(ws) < 6 THEN 4e-1 ELSE 0e0 END - CASE WHEN len(ws) > 120 THEN 2e-1 ELSE 0e0 END
  - CASE WHEN NOT regexp_matches(t, '[?.]$') THEN 15e-2 ELSE 0e0 END - CASE WHEN contains(x, '**') OR contains(x, '__') THEN 2e-1 ELSE 0e0 END
  - CASE WHEN regexp_matches(x, '(?i)^(here is|question:|answer:)') THEN 3e-1 ELSE 0e0 END
  - CASE WHEN x <> '' AND NOT regexp_matches(x, '^\p{{Lu}}') THEN 1e-1 ELSE 0e0 END AS s FROM b)
SELECT conv_id, turn, greatest(0e0, round(s, 2)) AS score, s >= 7e-1 AS passed FROM s"""
)
def grammar_gate(spark, sf_dir):
    s = G.grammar_gate(F.col("text"))
    return _turns(spark, sf_dir, score=F.greatest(F.lit(0.0), F.round(s, 2)), passed=s >= 0.70)


_INTROS = " + ".join(f"CAST(regexp_matches(lower(t), '{p}') AS INT)" for p in G.INTRO)


@_query(
    rf"""{TURNS}, r AS (SELECT *, len(list_filter(list_transform(ws, lambda w: regexp_replace(lower(w), '[,.?:!"'']+$', '')), lambda w: list_contains({_list(G.INFORMAL)}, w))) AS slang,
  {_INTROS} AS intros FROM b)
SELECT conv_id, turn, CAST(CASE WHEN t = '' THEN 1 ELSE CAST(NOT regexp_matches(t, '^\p{{Lu}}') AS INT) + CAST(NOT regexp_matches(t, '[.?!]$') AS INT) + slang + intros
  + CAST(len(ws) < 4 OR len(ws) > 60 AS INT) END AS INT) AS issues, CAST(CASE WHEN t = '' THEN 0 ELSE slang END AS INT) AS slang FROM r"""
)
def grammar_issues(spark, sf_dir):
    found = G.grammar_issues(F.col("text"))
    return _turns(spark, sf_dir, issues=F.size(found), slang=F.size(F.filter(found, lambda x: x == "slang_detected")))


_KINDS = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{k}'" for k, p in G.KINDS.items())


@_query(f"{TURNS} SELECT conv_id, turn, CASE {_KINDS} WHEN len(ws) < 10 THEN 'short' WHEN len(ws) > 30 THEN 'long' ELSE 'descriptive' END AS kind FROM b")
def question_kind(spark, sf_dir):
    return _turns(spark, sf_dir, kind=G.question_kind(F.col("text")))


_CONCEPTS = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{k}'" for k, p in G.CONCEPTS.items())


@_query(
    f"""WITH {_base("documents", "doc_id")}, k AS (SELECT doc_id, low, CASE {_CONCEPTS} ELSE 'theoretical' END AS kind FROM b)
SELECT doc_id, kind, CASE kind WHEN 'numerical' THEN 'L3,L4' WHEN 'diagram' THEN 'L2,L3' WHEN 'derivation' THEN 'L4,L5' ELSE
  CASE WHEN {_any(("define", "definition"))} THEN 'L1,L2' WHEN {_any(("compare", "difference"))} THEN 'L4' WHEN {_any(("design", "propose"))} THEN 'L6' ELSE 'L2,L3' END END AS levels FROM k"""
)
def concept_kind_levels(spark, sf_dir):
    made = _read(spark, sf_dir, "documents").select("doc_id", "text", G.concept_kind(F.col("text")).alias("kind"))
    return made.select("doc_id", "kind", F.array_join(G.suggested_levels(F.col("text"), F.col("kind")), ",").alias("levels"))


_LEVELS = " ".join(f"WHEN {_any(v)} THEN '{k}'" for k, v in T.VERBS.items())
_ASKS = " + ".join(f"CASE WHEN {_any(v)} THEN {f}::DOUBLE ELSE 0e0 END" for f, v in G.FACTORS)


@_query(
    f"""{TURNS}, l AS (SELECT *, CASE {_LEVELS} ELSE 'L2' END AS level, CASE WHEN len(ws) < 15 THEN 85e-2 WHEN len(ws) < 30 THEN 1e0 ELSE 12e-1 END AS f FROM b),
w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE, {G.MARK_RANGES[k][0]}, {G.MARK_RANGES[k][1]})" for k, v in G.WEIGHTS.items())}) AS w(level, base, lo, hi))
SELECT conv_id, turn, level, CAST(greatest(lo, least(hi, CAST(round_even(base * f * (1e0 + {_ASKS}) * 22e-1, 0) AS INT))) AS INT) AS marks FROM l JOIN w USING (level)"""
)
def question_optimal_marks(spark, sf_dir):
    made = _read(spark, sf_dir, "conversations").withColumn("level", T.bloom_ascending(F.col("text")))
    return made.select("conv_id", "turn", "level", G.optimal_marks(F.col("text"), F.col("level")).alias("marks"))


_DANGLING = " OR ".join(f"regexp_matches(t, '{p}')" for p in G.DANGLING)
_OPENS = " OR ".join(f"starts_with(lower(t), '{p}')" for p in G.PREAMBLES)


@_query(
    rf"""{TURNS}, s AS (SELECT *, list_reduce(list_prepend('', regexp_extract_all(t, '[()\[\]{{}}]')), lambda a, c: CASE WHEN a = '!' THEN a WHEN contains('([{{', c) THEN a || c
    WHEN a <> '' AND right(a, 1) = translate(c, ')]}}', '([{{') THEN a[1:length(a) - 1] ELSE '!' END) AS open,
  regexp_replace(lower(ws[1]), '^[.,;:()]+|[.,;:()]+$', '', 'g') AS first FROM b)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN len(ws) < 5 THEN 'short' WHEN {_DANGLING} THEN 'dangling'
  WHEN open <> '' OR length(regexp_replace(t, '[^"]', '', 'g')) % 2 <> 0 THEN 'unbalanced' WHEN NOT regexp_matches(t, '[.?!]$') THEN 'punctuation'
  WHEN NOT (list_contains({_list(G.COMMANDS)}, first) OR {_OPENS}) THEN 'structure' ELSE 'complete' END AS verdict FROM s"""
)
def question_completeness(spark, sf_dir):
    return _turns(spark, sf_dir, verdict=G.completeness(F.col("text")))


@_query(
    rf"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS q, lower(coalesce(text, '')) AS low, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS e FROM conversations),
k AS (SELECT *, lower(e || ' ') AS known, list_filter(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}') AND NOT list_contains({_list(G.UNGROUNDED)}, w)) AS terms FROM p),
c AS (SELECT *, len(list_filter(terms, lambda w: contains(known, w))) / greatest(len(terms), 1) AS share,
  len(list_distinct(list_filter(regexp_extract_all(q, '\b[0-9]+(?:\.[0-9]+)?\b'), lambda w: NOT list_contains(regexp_extract_all(q, '(?i)([0-9]+)\s*marks?', 1), w)
    AND NOT list_contains(regexp_extract_all(known, '\b[0-9]+(?:\.[0-9]+)?\b'), w)))) AS invented FROM k),
g AS (SELECT *, CASE WHEN invented = 0 OR regexp_matches(low, '{G.WORKED}') THEN share WHEN invented >= 2 THEN least(share, 45e-2) ELSE least(share, greatest(4e-1, share - 15e-2)) END AS coverage,
  CASE WHEN {_any(G.LENIENT)} THEN 25e-2 WHEN len(regexp_extract_all(known, '[^\s\x0b]+')) < 80 THEN 3e-1 ELSE 35e-2 END AS bar FROM c)
SELECT conv_id, turn, round(CASE WHEN e = '' THEN 7e-1 WHEN len(terms) = 0 THEN 75e-2 ELSE coverage END, 6) AS coverage, e = '' OR len(terms) = 0 OR coverage >= bar AS passed FROM g"""
)
def grounding_gate(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").withColumn("_next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    made = rows.select("conv_id", "turn", G.grounding(F.col("text"), F.col("_next")).alias("g"))
    return made.select("conv_id", "turn", F.round("g.coverage", 6).alias("coverage"), F.col("g.passed").alias("passed"))


@_query(
    r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_split_to_array(coalesce(text, ''), '\n+')[i], '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS p, i
  FROM documents, unnest(range(1, len(regexp_split_to_array(coalesce(text, ''), '\n+')) + 1)) AS r(i)),
n AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM p WHERE length(p) > 30)
SELECT doc_id, CAST(least(i // (n // 5), 4) AS INT) AS segment, count(*) AS paragraphs, CAST(sum(len(regexp_extract_all(p, '[^\s\x0b]+'))) AS BIGINT) AS words FROM n WHERE n >= 5 GROUP BY ALL"""
)
def doc_paragraph_groups(spark, sf_dir):
    """The texts of the table have no blank lines: every line is a paragraph here."""
    made = segment.paragraph_groups(_read(spark, sf_dir, "documents"), "doc_id", "text", 5, r"\n+")
    return made.select("doc_id", "segment", F.size("paragraphs").cast("long").alias("paragraphs"), F.aggregate("paragraphs", F.lit(0).cast("long"), lambda a, p: a + F.size(G.words(p))).alias("words"))


@_query()
def doc_sentence_packs(spark, sf_dir):
    """Sentences gathered until the next would pass 300 words. Greedy, so not in SQL: tests hold it against brute force."""
    made = segment.sentence_packs(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("doc_id", "pack_no", "words", F.md5("pack").alias("pack_hash"))


@_query()
def doc_sentence_modules(spark, sf_dir):
    """At most five modules of about equal words, cut at sentences. Greedy, so not in SQL: tests hold it against brute force."""
    made = segment.sentence_packs(_read(spark, sf_dir, "documents"), "doc_id", "text", modules=5)
    return made.select("doc_id", "pack_no", "words", F.md5("pack").alias("pack_hash"))


_CHUNKED = "WITH " + CHUNKS_SQL.format(step=270, size=300)
_SCORED = f"{_CHUNKED}, src AS (SELECT doc_id, chunk_no, chunk AS text FROM chunks), {CHUNK_SQL}"
_FIT = f"reason NOT IN ({', '.join(repr(r) for r in quality.HARD)}) AND academic >= 1"


def _chunks(spark, sf_dir):
    return segment.word_chunks(_read(spark, sf_dir, "documents"), "doc_id", "text", 300, 30)


@_query(
    f"""{_SCORED}, n AS (SELECT doc_id, count(*) AS chunks, {", ".join(f"count(*) FILTER ({_FIT} AND quality >= {s}) AS n{i}" for i, s in enumerate(quality.STEPS))} FROM scored GROUP BY doc_id),
a AS (SELECT *, CASE WHEN n0 > 0 THEN n0 WHEN n1 > 0 THEN n1 ELSE n2 END AS accepted FROM n)
SELECT doc_id, CASE WHEN n0 > 0 THEN 7e-1 WHEN n1 > 0 THEN 55e-2 ELSE 4e-1 END AS threshold, accepted, chunks, round(accepted / chunks, 4) AS pass_rate FROM a"""
)
def doc_adaptive_threshold(spark, sf_dir):
    return quality.adaptive_threshold(quality.chunk_quality(_chunks(spark, sf_dir), "chunk"), "doc_id")


@_query(f"{_SCORED} SELECT reason, count(*) AS chunks, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM scored GROUP BY reason")
def chunk_report(spark, sf_dir):
    made = quality.chunk_quality(_chunks(spark, sf_dir), "chunk").groupBy("reason").agg(F.count("*").alias("chunks"))
    # a handful of reasons is left by now
    return made.select("reason", "chunks", F.round(F.col("chunks") / F.sum("chunks").over(Window.partitionBy(F.lit(1))), 6).alias("share"))


@_query(
    f"""{_CHUNKED}, n AS (SELECT doc_id, chunk_no, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM chunks)
SELECT doc_id, chunk_no, greatest(1, CAST(floor((i - 1) / greatest(n - 1, 1) * 100) AS BIGINT) + 1) AS first_page,
  least(100, CAST(floor((i - 1) / greatest(n - 1, 1) * 100) AS BIGINT) + 1 + greatest(1, CAST(floor(100 / greatest(n, 1)) AS BIGINT))) AS last_page FROM n"""
)
def chunk_page_range(spark, sf_dir):
    w = Window.partitionBy("doc_id")
    rows = _chunks(spark, sf_dir).select("doc_id", "chunk_no", F.row_number().over(w.orderBy("chunk_no")).alias("i"), F.count("*").over(w).alias("n"))
    first, last = segment.page_range(F.col("i"), F.col("n"), 100)
    return rows.select("doc_id", "chunk_no", first.alias("first_page"), last.alias("last_page"))


@_query(
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
g AS (SELECT doc_id, k, s[k * greatest(1, len(s) // 4) + 1:CASE WHEN k < 3 THEN (k + 1) * greatest(1, len(s) // 4) ELSE len(s) END] AS part FROM s, unnest(range(0, 4)) AS r(k))
SELECT doc_id, CAST(k AS INT) AS segment, CAST(len(part) AS INT) AS sentences, md5(array_to_string(part, ' ')) AS hash FROM g WHERE regexp_matches(array_to_string(part, ' '), '[^\s\x0b]')"""
)
def doc_sentence_groups(spark, sf_dir):
    made = segment.sentence_groups(_read(spark, sf_dir, "documents"), "doc_id", "text", 4)
    return made.select("doc_id", "segment", F.size("sentences").alias("sentences"), F.md5(F.array_join("sentences", " ")).alias("hash"))


_PARTS = ", ".join(f"CASE WHEN {_any(v)} THEN '{k}' END" for k, v in G.COMPONENTS.items())


@_query(f"{TURNS} SELECT conv_id, turn, array_to_string(list_filter([{_PARTS}], lambda c: c IS NOT NULL), ',') AS components FROM b")
def answer_components(spark, sf_dir):
    return _turns(spark, sf_dir, components=F.array_join(G.answer_components(F.col("text")), ","))


@_query(
    """WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey AS paper, l_linenumber AS part, CASE WHEN i / greatest(n - 1, 1) <= 25e-2 THEN 'easy' WHEN i / greatest(n - 1, 1) <= 75e-2 THEN 'medium' ELSE 'hard' END AS difficulty FROM n"""
)
def paper_part_difficulty(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    rows = _read(spark, sf_dir, "lineitem").withColumns({"i": F.row_number().over(w.orderBy("l_linenumber")) - 1, "n": F.count("*").over(w)})
    return rows.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("part"), G.position_difficulty(F.col("i"), F.col("n")).alias("difficulty"))
