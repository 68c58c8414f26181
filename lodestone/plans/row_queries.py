"""Queries of the text operators over documents, conversations and parts, with their DuckDB SQL."""

from __future__ import annotations

from ..operators import dialect, texts

_DOCS = "SELECT doc_id AS id, text FROM {documents}"
_TURNS = "SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, text FROM {conversations}"
#: The tables have no numbered headings, marks or contents: lines that carry them are put before some texts.
_MARKED = """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Module ' || CAST(doc_id % 5 AS STRING) || ': Basics of Things' || <<nl>> || 'CO1: outcome one' || <<nl>> || 'first topic, second topic and third one' || <<nl>> ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN 'Chapter 2 Hashing ..... 39' || <<nl>> || '41  2.1 Hash Tables' || <<nl>> || '5.1' || <<nl>> || '5.2 On-Board Diagnostics' || <<nl>> || 'Page 3 of 9' || <<nl>> ELSE '' END
  || replace(coalesce(text, ''), '. ', '.' || <<nl>>) || CASE WHEN doc_id % 5 = 0 THEN <<nl>> || '' || <<nl>> || 'Q1) Explain the working of it' || <<nl>> || 'in detail [10 Marks]' || <<nl>> || 'Figure 3 shows it above' ELSE '' END AS text FROM {documents}"""
_ASKED = "SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence, CAST(turn % 6 + 1 AS INT) AS level, CAST(2 + turn % 9 AS INT) AS marks, turn % 4 = 0 AS needs_figure FROM {conversations}"

USES = {
    "doc_clean_lines": ("clean_lines", {"docs": _MARKED}),
    "doc_without_headers": ("without_headers", {"docs": _MARKED}),
    "doc_without_contents": ("without_contents", {"docs": _MARKED}),
    "doc_section_titles": ("section_titles", {"docs": _MARKED}),
    "doc_sections": ("sections", {"docs": _MARKED}),
    "doc_bare_texts": ("bare_texts", {"docs": _DOCS}),
    "turn_completed": ("completed", {"docs": _TURNS}),
    "turn_realised": ("realised", {"docs": _TURNS}),
    "turn_model_output": ("model_output", {"docs": _TURNS}),
    "doc_keywords": ("keywords", {"docs": _DOCS}),
    "name_index": ("index_names", {"docs": "SELECT p_partkey AS id, p_name AS text FROM {part}"}),
    "turn_templates": ("templates", {"docs": _TURNS}),
    "doc_marker_segments": ("marker_segments", {"docs": _MARKED}),
    "doc_title_segments": ("heading_segments", {"docs": _MARKED}),
    "doc_segment_strategy": ("segment_cascade", {"docs": _DOCS, "segments": "SELECT doc_id AS id, 1 + CAST(doc_id % 4 AS INT) AS strategy, lang AS segment, n_chars AS words FROM {documents} UNION ALL SELECT doc_id AS id, 2 AS strategy, source AS segment, 60 AS words FROM {documents} UNION ALL SELECT doc_id AS id, 2 AS strategy, lang AS segment, 70 AS words FROM {documents} WHERE doc_id % 2 = 0"}),
    "doc_contents_entries": ("contents_entries", {"docs": _MARKED}),
    "doc_syllabus": ("syllabus", {"docs": _MARKED}),
    "turn_level_by_word": ("level_by_word", {"docs": _TURNS}),
    "doc_marked_questions": ("marked_questions", {"docs": _MARKED}),
    "turn_question_lines": ("question_lines", {"docs": _TURNS}),
    "doc_block_types": ("block_types", {"docs": _MARKED}),
    "page_kinds": ("page_kinds", {"pages": f"SELECT id, CAST(id % 60 AS INT) AS page, text FROM ({_MARKED}) m"}),
    "doc_noise_verdicts": ("noise_verdicts", {"docs": _DOCS}),
    "concept_verdicts": ("concept_verdicts", {"concepts": "SELECT doc_id AS id, regexp_extract(text, r'^[^\n]*', 0) AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE regexp_extract(text, r'\n([^\n]*)', 1) END AS definition, text FROM {documents}"}),
    "question_critic": ("critic", {"asked": _ASKED}),
    "marks_figure_gates": ("marks_gate", {"asked": _ASKED}),
    "final_audit": ("final_audit", {"gates": "SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'grounding' ELSE 'marks' END AS gate, 1e0 - l_discount * 5 AS score, l_discount < 8e-2 AS passed FROM {lineitem}"}),
    "question_verb": ("verb_of_question", {"docs": _TURNS}),
    "turn_level_by_pattern": ("level_by_pattern", {"docs": _TURNS}),
    "doc_scan_confidence": ("scan_confidence", {"docs": _DOCS}),
    "page_text_confidence": ("page_text_confidence", {"pages": "SELECT source AS doc, text FROM {documents}"}),
    "doc_figure_types": ("figure_types", {"docs": _MARKED}),
    "doc_chunk_sizes": ("chunk_sizes", {"docs": _DOCS}),
    "doc_paragraph_questions": ("paragraph_questions", {"docs": _MARKED}),
    "answer_quality": ("answer_quality", {"answers": "SELECT doc_id AS id, coalesce(text, '') AS text, CASE WHEN doc_id % 2 = 0 THEN regexp_extract(text, r'^[^\n]*', 0) ELSE 'none of it' END AS definition, CASE WHEN doc_id % 3 = 0 THEN regexp_extract(text, r'\n([^\n]*)', 1) ELSE '' END AS point, CASE WHEN doc_id % 5 = 0 THEN regexp_extract(text, r'[^\n]*$', 0) ELSE '~' END AS application, '' AS algorithm, doc_id % 7 = 0 AS needs_figure FROM {documents}"}),
    "benchmark_contamination": ("contamination", {"items": "SELECT item_id AS id, text FROM {benchmark}", "docs": _DOCS}),
    "turn_novelty": ("novelty", {"questions": "SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, conv_id AS grp, turn AS seq, text FROM {conversations}"}),
    "topic_samples": ("topic_samples", {"topics": "SELECT p_type AS topic, max(p_size) > 40 AS has_figure FROM {part} GROUP BY p_type"}),
    "question_plan": ("question_plan", {"modules": "SELECT p_brand AS subject, p_type AS module, count(*) AS chunks FROM {part} GROUP BY p_brand, p_type"}),
    "paper_template": ("paper_template", {"papers": "SELECT o_orderkey AS paper, CASE WHEN o_orderstatus = 'F' THEN 'IA' ELSE 'SEE' END AS kind FROM {orders}"}),
}

QUERIES, ORACLE_SQL = dialect.register(texts.OPERATORS, USES)
