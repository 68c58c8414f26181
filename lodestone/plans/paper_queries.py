"""Queries of the paper, concept, reward and join operators over the tables at hand, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import dialect, pairing, papers

_Q = """SELECT l_orderkey AS paper, CAST(l_linenumber AS INT) AS mq, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS INT) AS part,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS place, CAST(l_quantity AS INT) AS marks, CAST(l_suppkey % 6 + 1 AS INT) AS level,
  CAST(l_partkey % 5 + 1 AS INT) AS co, l_returnflag AS verb, l_linestatus AS kind FROM {lineitem}"""
_TARGET = "SELECT * FROM (VALUES ('O', 6e-1), ('F', 3e-1), ('X', 1e-1)) AS t(kind, share)"
_CONCEPTS = """SELECT p_name AS name, p_name AS definition, p_type || ' ' || p_name || ' ' || p_type || ' ' || p_type AS explanation, p_partkey % 2 = 0 AS in_syllabus, p_partkey % 7 = 0 AS in_outcome, CAST(p_size % 5 AS INT) AS books, CAST(p_partkey % 40 AS INT) AS bank,
  CAST(p_partkey % 23 AS INT) AS papers, p_partkey % 3 = 0 AS notes, p_partkey % 11 <> 0 AS defined, p_type LIKE '%STEEL%' AS diagram, CAST(1 + p_partkey % 2 AS INT) AS modules, CAST(p_partkey % 6 + 1 AS INT) AS level FROM {part}"""
_ITEMS = "SELECT p_brand AS subject, CAST(p_size AS INT) AS marks, p_type AS topic, p_partkey AS id FROM {part}"
_CANDIDATES = """SELECT o_custkey AS grp, o_orderkey AS id, (o_orderkey % 11) / 11e0 AS faithful, (o_orderkey % 13) / 13e0 AS original, (o_orderkey % 7) / 7e0 AS judged, (o_orderkey % 5) / 5e0 AS fingerprint,
  (o_orderkey % 3) / 3e0 AS bloom, (o_orderkey % 17) / 17e0 AS simulation, (o_orderkey % 19) / 19e0 AS path, (o_orderkey % 2) / 2e0 AS penalty FROM {orders}"""
_REWARDS = "SELECT o_custkey AS grp, o_orderkey AS id, (o_orderkey % 11) / 11e0 AS reward FROM {orders}"
_RANKED = """SELECT o_custkey AS grp, o_orderkey AS id, o_orderkey % 4 > 0 AS aligned, CAST(o_orderkey % 5 AS INT) AS covered, CAST(o_custkey % 6 AS INT) AS required, CAST(o_orderkey % 2 AS INT) AS capital, CAST(o_orderkey % 3 % 2 AS INT) AS ended,
  CAST(o_custkey % 2 AS INT) AS fits, 1 AS verb_first, (o_orderkey % 7) / 7e0 AS novelty, (o_orderkey % 9) / 9e0 AS style FROM {orders}"""
_PAGES = "SELECT l_orderkey AS doc, CAST(l_linenumber AS INT) AS page, CAST(l_linenumber + l_orderkey % 4 + l_suppkey % 2 AS INT) AS pdf, CAST(l_linenumber AS INT) AS printed FROM {lineitem}"
_FILES = "SELECT source AS grp, lang AS subject, length(text) > 0 AS done, length(text) < 30 AS failed FROM {documents}"
_SEQ = "SELECT user_id AS doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, event_id"

#: query: operator, its inputs over the tables at hand
USES = {
    "paper_numbering": ("numbering", {"questions": _Q}),
    "paper_submarks": ("submarks", {"questions": _Q, "declared": "SELECT l_orderkey AS paper, CAST(l_linenumber AS INT) AS mq, CAST(max(l_quantity) AS INT) + CAST(max(l_partkey) % 2 AS INT) AS declared FROM {lineitem} GROUP BY l_orderkey, l_linenumber"}),
    "paper_or_parity_enforced": ("or_parity_enforced", {"questions": _Q}),
    "paper_level_shares": ("level_shares", {"questions": _Q}),
    "paper_outcome_shares": ("outcome_shares", {"questions": _Q}),
    "paper_chief_checks": ("chief_checks", {"questions": _Q}),
    "paper_coverage_score": ("coverage_score", {"questions": _Q, "target": _TARGET}),
    "paper_cognitive_balance": ("cognitive_balance", {"questions": _Q, "target": _TARGET}),
    "examiner_style": ("examiner_style", {"questions": _Q}),
    "examiner_preferred_marks": ("preferred_marks", {"questions": _Q}),
    "examiner_patterns": ("pattern_upsert", {"questions": _Q}),
    "paper_component_marks": ("component_marks", {"questions": _Q}),
    "module_coverage": ("module_coverage", {"topics": "SELECT DISTINCT p_brand AS module, p_name AS topic FROM {part}", "concepts": "SELECT p_name AS name, min(p_retailprice) / 2000e0 AS confidence, max(CAST(p_size % 6 + 1 AS INT)) AS level FROM {part} GROUP BY p_name HAVING min(p_partkey) % 3 > 0"}),
    "evidence_confidence": ("evidence_confidence", {"concepts": _CONCEPTS}),
    "importance_score": ("importance_score", {"concepts": _CONCEPTS}),
    "understanding_scores": ("understanding_scores", {"concepts": _CONCEPTS}),
    "source_reliability": ("source_reliability", {"sources": "SELECT s_suppkey AS source, 75e-2 AS base, (s_suppkey % 7) / 7e0 AS depth, (s_suppkey % 5) / 5e0 AS coverage, (s_suppkey % 3) / 3e0 AS grammar, (s_suppkey % 2) / 2e0 AS diagrams, (s_suppkey % 4) / 4e0 AS rating FROM {supplier}"}),
    "merge_enrich": ("merge_enrich", {"candidates": """SELECT p_brand AS name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS seq, CAST(p_size AS DOUBLE) / 50 AS reliability, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS definition, p_name AS explanation,
      p_type AS point, CASE p_partkey % 4 WHEN 0 THEN 'previous_paper' WHEN 1 THEN 'question_bank' WHEN 2 THEN 'notes' ELSE 'textbook' END AS kind, p_size > 45 AS diagram FROM {part}"""}),
    "weakest_dimension": ("weakest_dimension", {"memory": "SELECT c_nationkey AS subject, (c_custkey % 7) / 7e0 AS understand, (c_custkey % 5) / 5e0 AS explain, (c_custkey % 3) / 3e0 AS compare, (c_custkey % 11) / 11e0 AS ask, (c_custkey % 13) / 13e0 AS answer, (c_custkey % 17) / 17e0 AS predict FROM {customer}"}),
    "audit_report": ("audit_report", {"audits": "SELECT o_custkey AS run, CASE WHEN o_orderkey % 13 = 0 THEN 'VIOLATED' WHEN o_orderkey % 11 = 0 THEN 'BYPASSED' WHEN o_orderkey % 5 = 0 THEN 'DEGRADED' ELSE 'COMPLIANT' END AS verdict, (o_orderkey % 9) / 8e0 AS confidence FROM {orders}"}),
    "component_confidence": ("component_confidence", {"parts": "SELECT l_orderkey AS run, l_quantity AS weight, 1e0 - l_discount AS confidence, l_returnflag = 'R' AS critical FROM {lineitem}"}),
    "flag_rates": ("flag_rates", {"rows": "SELECT d.source, l.toxic = 1 AS flagged FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"}),
    "reward_scores": ("reward", {"candidates": _CANDIDATES}),
    "group_advantage": ("group_advantage", {"rewards": _REWARDS}),
    "preference_pairs": ("preference_pairs", {"rewards": _REWARDS}),
    "call_log": ("call_log", {"calls": "SELECT event_type AS kind, value AS latency, event_type = 'error' AS failed FROM {events}"}),
    "rule_counts": ("rule_counts", {"fires": "SELECT event_type AS rule, value > 90 AS critical FROM {events}"}),
    "raft_examples": ("raft_examples", {"examples": _ITEMS}),
    "hard_negative_pool": ("hard_negative_pool", {"items": _ITEMS}),
    "name_resolution": ("name_resolution", {"wanted": "SELECT p_partkey AS id, upper(p_name) AS needs FROM {part}", "named": "SELECT p_partkey + 1 AS id, p_name AS name FROM {part}"}),
    "plan_units": ("plan_units", {"slots": "SELECT p_partkey AS slot, p_type AS concept FROM {part}", "units": "SELECT p_type AS concept, min(p_partkey) AS unit FROM {part} WHERE p_size > 40 GROUP BY p_type"}),
    "weighted_sample": ("weighted_sample", {"items": _ITEMS, "weights": "SELECT p_brand AS subject, min(p_size) / 50e0 AS share FROM {part} GROUP BY p_brand"}),
    "toc_ranges": ("toc_ranges", {"entries": "SELECT DISTINCT l_orderkey AS doc, 'part ' || CAST(l_linenumber AS STRING) AS title, CAST(l_linenumber * 2 AS INT) AS page FROM {lineitem} WHERE l_linenumber % 2 = 1", "pages": "SELECT l_orderkey AS doc, CAST(l_linenumber * 2 + l_suppkey % 2 AS INT) AS page FROM {lineitem}"}),
    "page_offset": ("page_offset", {"pages": _PAGES}),
    "nearest_heading": ("nearest_above", {"blocks": "SELECT user_id AS doc, event_id AS id, CASE WHEN event_type = 'view' THEN 'head' ELSE 'text' END AS kind FROM {events}"}),
    "native_over_ocr": ("rows_without_source", {"ocr": "SELECT o_custkey AS page, o_orderkey AS id FROM {orders} WHERE o_orderstatus <> 'F'", "native": "SELECT o_custkey AS page, o_orderkey AS id FROM {orders} WHERE o_orderstatus = 'F'"}),
    "topic_index": ("inverted_index", {"items": _ITEMS}),
    "answer_coverage": ("answer_coverage", {"concepts": "SELECT DISTINCT p_type AS concept FROM {part}", "answers": "SELECT p_type AS concept, avg(p_size / 50e0) AS quality FROM {part} WHERE p_size > 45 GROUP BY p_type"}),
    "training_readiness": ("readiness", {"files": _FILES}),
    "subject_conflicts": ("conflicts", {"files": _FILES}),
    "status_machine": ("status_machine", {"moves": _SEQ + ", CASE event_type WHEN 'signup' THEN 'registered' WHEN 'view' THEN 'extracting' WHEN 'click' THEN 'extracted' WHEN 'purchase' THEN 'ready' ELSE 'failed' END AS status FROM {events}"}),
    "curriculum_filter": ("curriculum_filter", {"samples": "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_suppkey % 6 + 1 AS INT) AS level, l_returnflag AS kind FROM {lineitem}", "stage": "SELECT * FROM (VALUES (1, 'A'), (2, 'A')) AS t(level, kind)"}),
    "export_rows": ("export_rows", {"rows": "SELECT d.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'flagged' WHEN l.quality IS NULL THEN 'pending' WHEN d.doc_id % 4 = 0 THEN 'approved' ELSE 'reviewed' END AS status, (d.doc_id % 10) / 9e0 AS score FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"}),
    "hit_rows": ("hit_rows", {"hits": "SELECT o_custkey AS query, o_orderkey AS id, o_orderpriority AS module FROM {orders}", "rows": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'other' ELSE o_orderpriority END AS module FROM {orders}"}),
    "merged_lists": ("merged_lists", {"lists": "SELECT p_brand AS grp, p_type AS item, p_partkey AS seq FROM {part}"}),
    "style_similarity": ("style_similarity", {"real": "SELECT 'verb' AS field, l_returnflag AS name FROM {lineitem} WHERE l_orderkey % 2 = 0 UNION ALL SELECT 'level' AS field, CAST(l_suppkey % 6 AS STRING) AS name FROM {lineitem} WHERE l_orderkey % 2 = 0 UNION ALL SELECT 'marks' AS field, CAST(l_linenumber AS STRING) AS name FROM {lineitem} WHERE l_orderkey % 2 = 0",
      "made": "SELECT 'verb' AS field, l_linestatus AS name FROM {lineitem} WHERE l_orderkey % 2 = 1 UNION ALL SELECT 'verb' AS field, l_returnflag AS name FROM {lineitem} WHERE l_orderkey % 2 = 1 UNION ALL SELECT 'level' AS field, CAST(l_partkey % 6 AS STRING) AS name FROM {lineitem} UNION ALL SELECT 'marks' AS field, CAST(l_linenumber % 3 AS STRING) AS name FROM {lineitem}"}),
    "marks_by_weight": ("marks_by_weight", {"weights": "SELECT l_orderkey AS grp, l_orderkey * 10 + l_linenumber AS id, l_quantity AS weight, 20 AS total FROM {lineitem}"}),
    "topic_allocation": ("topic_allocation", {"topics": "SELECT DISTINCT p_brand AS subject, p_type AS topic FROM {part}", "questions": "SELECT p_brand AS subject, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS question FROM {part}"}),
    "question_ranking": ("question_ranking", {"candidates": _RANKED}),
    "best_question": ("best_question", {"ranked": "SELECT o_custkey AS grp, o_orderkey AS id, o_orderkey % 3 = 0 AS out, (o_orderkey % 17) / 17e0 AS overall, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 17 DESC, o_orderkey) AS INT) AS place FROM {orders}"}),
    "retrieval_gate": ("retrieval_gate", {"retrieved": "SELECT o_orderkey AS query, CAST(o_orderkey % 5 AS INT) AS chunks, CAST(o_custkey % 300 AS INT) AS words, CAST(o_custkey % 13 AS INT) AS academic, (o_orderkey % 7) / 7e0 AS coverage, (o_orderkey % 11) / 11e0 AS overlap FROM {orders}"}),
    "guardrails": ("guardrails", {"rows": "SELECT o_orderkey AS id, (o_orderkey % 11) / 10e0 AS copied, (o_custkey % 13) / 12e0 AS banked, o_orderkey % 3 > 0 AS faithful FROM {orders}"}),
    "stage_progress": ("stage_progress", {"signals": "SELECT user_id AS concept, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, value / 100e0 AS understand, (event_id % 10) / 10e0 AS compare, (event_id % 7) / 7e0 AS explain FROM {events}"}),
    "promotion_check": ("promotion", {"before": "SELECT 'm' || CAST(s_nationkey AS STRING) AS metric, avg(s_acctbal) AS v FROM {supplier} WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey", "after": "SELECT CASE WHEN s_nationkey = 3 THEN 'overall_score' ELSE 'm' || CAST(s_nationkey AS STRING) END AS metric, avg(s_acctbal) AS v FROM {supplier} WHERE s_suppkey % 2 = 1 GROUP BY s_nationkey"}),
    "epoch_replace": ("replace_epoch", {"old": "SELECT o_orderkey AS epoch, o_totalprice AS v FROM {orders} WHERE o_orderstatus <> 'P'", "new": "SELECT o_orderkey AS epoch, o_totalprice + 1 AS v FROM {orders} WHERE o_orderstatus <> 'F'"}),
    "first_seen": ("ordered_distinct", {"items": "SELECT p_brand AS grp, p_type AS name, p_partkey AS seq FROM {part}"}),
    "figure_provenance": ("provenance", {"figures": "SELECT p_partkey AS id, p_partkey % 2 = 0 AS refs, p_partkey % 3 = 0 AS caption, CAST(p_size AS INT) AS words, p_partkey % 5 = 0 AS section, p_partkey % 7 = 0 AS typed FROM {part}"}),
    "slot_order": ("slot_order", {"concepts": "SELECT p_brand AS module, CAST(p_partkey AS STRING) AS name, p_retailprice / 2000e0 AS importance, CAST(p_size AS DOUBLE) AS frequency FROM {part}"}),
    "longest_chunks": ("longest_chunks", {"chunks": "SELECT source AS module, doc_id AS id, size(regexp_extract_all(coalesce(text, ''), r'[^\\s]+', 0)) AS words FROM {documents}"}),
    "chunk_images": ("chunk_images", {"chunks": "SELECT p_brand AS module, p_partkey AS id, CAST(p_size % 3 AS INT) AS images FROM {part}"}),
    "edge_changes": ("edge_changes", {"edges": "SELECT DISTINCT c_nationkey AS src, c_custkey % 25 AS dst FROM {customer}", "added": "SELECT n_nationkey AS src, n_regionkey AS dst FROM {nation}", "removed": "SELECT c_nationkey AS src, c_custkey % 25 AS dst FROM {customer} WHERE c_custkey % 4 = 0"}),
    "model_rollback": ("rollback", {"versions": "SELECT o_custkey AS subject, o_orderkey AS version, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS active FROM {orders}"}),
    "pair_sources": ("union_sources", {"db": "SELECT doc_id AS id, md5(coalesce(text, '')) AS text FROM {documents}", "curated": "SELECT item_id AS id, md5(coalesce(text, '')) AS text FROM {benchmark}"}),
}

QUERIES, ORACLE_SQL = dialect.register(papers.OPERATORS, USES)


def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's SQL compares all pairs to keep each once; this has the same rows from blocks."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    wanted, named = (dialect.apply(spark, USES["name_resolution"][1][n], part=part) for n in ("wanted", "named"))
    return pairing.resolved(wanted, named)


QUERIES["name_resolution"] = name_resolution
