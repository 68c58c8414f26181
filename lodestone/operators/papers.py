"""Checks and scores of papers, concepts, edges and runs, over a caller's tables.

questions: paper, mq (from 1), part (from 1), marks, level (1 to 6), co (1 to 5), text. Weights and bounds are fixed values.
"""

from __future__ import annotations

OPERATORS: dict[str, str] = {}

# -- papers ------------------------------------------------------------------------------
OPERATORS["numbering"] = """
SELECT paper, bool_and(mq = n) AS in_order FROM (SELECT paper, mq, row_number() OVER (PARTITION BY paper ORDER BY first, mq) AS n
  FROM (SELECT paper, mq, min(place) AS first FROM {questions} GROUP BY paper, mq) q) x GROUP BY paper"""

OPERATORS["submarks"] = """
SELECT paper, mq, actual, declared FROM (SELECT q.paper, q.mq, sum(q.marks) AS actual, max(d.declared) AS declared
  FROM {questions} q JOIN {declared} d ON q.paper = d.paper AND q.mq = d.mq GROUP BY q.paper, q.mq) x WHERE declared > 0 AND actual <> declared"""

OPERATORS["or_parity_enforced"] = """
WITH t AS (SELECT *, sum(marks) OVER (PARTITION BY paper, mq) AS total, row_number() OVER (PARTITION BY paper, mq ORDER BY part DESC) AS from_end, floor((mq - 1) / 2) AS pair FROM {questions}),
g AS (SELECT *, max(total) OVER (PARTITION BY paper, pair) AS goal FROM t)
SELECT paper, mq, part, CASE WHEN from_end = 1 THEN greatest(1, marks + goal - total) ELSE marks END AS marks FROM g"""

OPERATORS["level_shares"] = """
WITH m AS (SELECT paper, level, sum(marks) AS marks, sum(sum(marks)) OVER (PARTITION BY paper) AS total FROM {questions} GROUP BY paper, level),
p AS (SELECT paper, level, CAST(bround(CAST(marks AS DOUBLE) / total * 100, 0) AS INT) AS share FROM m WHERE total > 0)
SELECT paper, CAST(sum(CASE WHEN level >= 4 THEN share ELSE 0 END) AS INT) AS higher, CAST(sum(CASE WHEN level = 1 THEN share ELSE 0 END) AS INT) AS lowest,
  sum(CASE WHEN level >= 4 THEN share ELSE 0 END) < 15 AS too_few_high, sum(CASE WHEN level = 1 THEN share ELSE 0 END) > 30 AS too_many_low FROM p GROUP BY paper"""

OPERATORS["outcome_shares"] = """
WITH solid AS (SELECT * FROM {questions} WHERE mq % 2 = 1)
SELECT paper, co, round(100e0 * sum(marks) / sum(sum(marks)) OVER (PARTITION BY paper), 2) AS share FROM solid GROUP BY paper, co"""

OPERATORS["chief_checks"] = """
WITH v AS (SELECT paper, verb, count(*) AS n, sum(count(*)) OVER (PARTITION BY paper) AS total FROM {questions} GROUP BY paper, verb),
f AS (SELECT paper, count_if(n * 2 > total AND total >= 4) AS warnings FROM v GROUP BY paper),
e AS (SELECT paper, 3 - count(DISTINCT CASE WHEN level >= 4 THEN 3 WHEN level >= 2 THEN 2 ELSE 1 END) AS errors FROM {questions} GROUP BY paper)
SELECT f.paper, e.errors, f.warnings, round(greatest(0e0, 1e0 - 2e-1 * e.errors - 5e-2 * f.warnings), 4) AS quality FROM f JOIN e ON f.paper = e.paper"""

OPERATORS["coverage_score"] = """
WITH actual AS (SELECT paper, kind, sum(marks) / CAST(sum(sum(marks)) OVER (PARTITION BY paper) AS DOUBLE) AS share FROM {questions} GROUP BY paper, kind),
met AS (SELECT a.paper, sum(coalesce(abs(t.share - a.share) - t.share, 0e0)) AS less FROM actual a LEFT JOIN {target} t ON a.kind = t.kind GROUP BY a.paper)
SELECT paper, round(greatest(0e0, 1e0 - ((SELECT sum(share) FROM {target}) + less) / (SELECT count(*) FROM {target})), 4) AS score FROM met"""

OPERATORS["cognitive_balance"] = """
WITH actual AS (SELECT paper, kind, count(*) / CAST(sum(count(*)) OVER (PARTITION BY paper) AS DOUBLE) AS share FROM {questions} GROUP BY paper, kind)
SELECT a.paper, a.kind, round(a.share - t.share, 4) AS off FROM actual a JOIN {target} t ON a.kind = t.kind WHERE abs(a.share - t.share) > 15e-2"""

OPERATORS["examiner_style"] = """
SELECT 'verb' AS field, verb AS name, count(*) AS n FROM {questions} GROUP BY verb
UNION ALL SELECT 'level' AS field, CAST(level AS STRING) AS name, count(*) AS n FROM {questions} GROUP BY level
UNION ALL SELECT 'marks' AS field, CAST(marks AS STRING) AS name, count(*) AS n FROM {questions} GROUP BY marks"""

OPERATORS["preferred_marks"] = """
SELECT verb, marks, n, CAST(rn AS INT) AS place FROM (SELECT verb, marks, count(*) AS n, row_number() OVER (PARTITION BY verb ORDER BY count(*) DESC, marks) AS rn FROM {questions} GROUP BY verb, marks) x WHERE rn <= 5"""

OPERATORS["pattern_upsert"] = """
SELECT verb, marks, level, count(*) AS frequency, array_join(sort_array(collect_set(kind)), ',') AS kinds FROM {questions} GROUP BY verb, marks, level"""

OPERATORS["component_marks"] = """
SELECT paper, mq, part, round(marks * CAST(level AS DOUBLE) / sum(level) OVER (PARTITION BY paper, mq), 1) AS share FROM {questions}"""

OPERATORS["module_coverage"] = """
SELECT m.module, count(*) AS topics, count(c.name) AS covered, round(count(c.name) / CAST(count(*) AS DOUBLE), 4) AS ratio, round(avg(c.confidence), 6) AS confidence, max(c.level) AS highest,
  coalesce(array_join(sort_array(collect_list(CASE WHEN c.name IS NULL THEN m.topic END)), '|'), '') AS missing FROM {topics} m LEFT JOIN {concepts} c ON lower(m.topic) = lower(c.name) GROUP BY m.module"""

# -- concepts --------------------------------------------------------------------------------
#: concepts: name, in_syllabus, in_outcome, books, bank, papers, notes, defined, diagram, modules, level
OPERATORS["evidence_confidence"] = """
WITH s AS (SELECT *, greatest(0e0, least(1e0, CASE WHEN in_syllabus THEN 4e-1 ELSE -5e-2 END + least(25e-2, books * 1e-1) + least(15e-2, bank * 3e-2) + least(15e-2, papers * 3e-2)
  + CASE WHEN notes THEN 1e-1 ELSE 0e0 END + CASE WHEN defined THEN 5e-2 ELSE 0e0 END + CASE WHEN diagram THEN 5e-2 ELSE 0e0 END)) AS c FROM {concepts})
SELECT name, round(c, 6) AS confidence, round(c, 9) < 85e-2 OR modules > 1 AS needs_verification FROM s"""

OPERATORS["importance_score"] = """
SELECT name, round(25e-2 * CASE WHEN in_syllabus THEN 1 ELSE 0 END + 1e-1 * CASE WHEN in_outcome THEN 1 ELSE 0 END + 15e-2 * least(1e0, books / 3e0) + 15e-2 * least(1e0, bank / 30e0)
  + 2e-1 * least(1e0, papers / 20e0) + 7e-2 * CASE WHEN notes THEN 1 ELSE 0 END
  + 8e-2 * CASE level WHEN 6 THEN 1e0 WHEN 5 THEN 9e-1 WHEN 4 THEN 8e-1 WHEN 3 THEN 7e-1 WHEN 2 THEN 5e-1 ELSE 3e-1 END, 4) AS importance FROM {concepts}"""

OPERATORS["understanding_scores"] = """
SELECT name, round(least(1e0, CASE WHEN defined THEN 3e-1 ELSE 0e0 END + CASE WHEN notes THEN 25e-2 ELSE 0e0 END + least(2e-1, books * 4e-2) + CASE WHEN bank > 0 THEN 1e-1 ELSE 0e0 END
  + CASE WHEN papers > 0 THEN 1e-1 ELSE 0e0 END + CASE WHEN diagram THEN 5e-2 ELSE 0e0 END), 4) AS understanding,
  round(least(1e0, CASE WHEN length(definition) > 30 THEN 35e-2 ELSE 0e0 END + CASE WHEN length(explanation) > 80 THEN 35e-2 ELSE 0e0 END + CASE WHEN books >= 3 THEN 2e-1 ELSE 0e0 END
  + CASE WHEN diagram THEN 1e-1 ELSE 0e0 END), 4) AS explainability FROM {concepts}"""

#: sources: source, kind, depth, coverage, grammar, diagrams, rating
OPERATORS["source_reliability"] = """
SELECT source, round(least(1e0, base * 5e-1 + (depth * 25e-2 + coverage * 2e-1 + grammar * 2e-1 + diagrams * 1e-1) * 5e-1 + CASE WHEN rating > 0 THEN rating * 25e-2 ELSE 0e0 END), 6) AS reliability FROM {sources}"""

#: candidates: name, seq, reliability, definition, explanation, points, kind, diagram
OPERATORS["merge_enrich"] = """
WITH r AS (SELECT *, max(reliability) OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {candidates}),
d AS (SELECT *, CASE WHEN definition <> '' AND (best IS NULL OR reliability > best) THEN seq END AS takes FROM r),
p AS (SELECT name, point, min(seq) AS met FROM {candidates} GROUP BY name, point),
l AS (SELECT name, count(*) AS points FROM p WHERE point <> '' GROUP BY name)
SELECT d.name, max_by(definition, takes) AS definition, max_by(explanation, CAST(length(explanation) AS BIGINT) * 1000000000 - seq) AS explanation, max(l.points) AS points, bool_or(diagram) AS diagram,
  count_if(kind = 'previous_paper' AND seq > 1) AS papers, count_if(kind = 'question_bank' AND seq > 1) AS bank, bool_or(kind = 'notes' AND seq > 1) AS notes FROM d LEFT JOIN l ON d.name = l.name GROUP BY d.name"""

#: memory: subject, concept, understand, explain, compare, ask, answer, predict
OPERATORS["weakest_dimension"] = """
WITH a AS (SELECT subject, round(avg(understand), 4) AS d1, round(avg(explain), 4) AS d2, round(avg(compare), 4) AS d3, round(avg(ask), 4) AS d4, round(avg(answer), 4) AS d5, round(avg(predict), 4) AS d6 FROM {memory} GROUP BY subject),
u AS (SELECT subject, 1 AS n, 'understand' AS dim, d1 AS v FROM a UNION ALL SELECT subject, 2 AS n, 'explain' AS dim, d2 AS v FROM a UNION ALL SELECT subject, 3 AS n, 'compare' AS dim, d3 AS v FROM a
  UNION ALL SELECT subject, 4 AS n, 'generate_question' AS dim, d4 AS v FROM a UNION ALL SELECT subject, 5 AS n, 'generate_answer' AS dim, d5 AS v FROM a UNION ALL SELECT subject, 6 AS n, 'predict_exam_use' AS dim, d6 AS v FROM a)
SELECT subject, dim, v FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY v, n) AS rn FROM u) x WHERE rn = 1"""

#: audits: run, verdict, confidence
OPERATORS["audit_report"] = """
SELECT run, CASE WHEN count_if(verdict = 'VIOLATED') > 0 THEN 'VIOLATED' WHEN count_if(verdict = 'BYPASSED') > 0 THEN 'BYPASSED' WHEN count_if(verdict = 'DEGRADED') > 0 THEN 'DEGRADED' ELSE 'COMPLIANT' END AS verdict,
  coalesce(round(exp(avg(CASE WHEN confidence > 0 THEN ln(confidence) END)), 4), 1e0) AS confidence,
  greatest(0, 100 - 20 * count_if(verdict = 'VIOLATED') - 15 * count_if(verdict = 'BYPASSED') - 8 * count_if(verdict = 'DEGRADED')) AS trust,
  greatest(0, 100 - 20 * count_if(verdict = 'VIOLATED') - 15 * count_if(verdict = 'BYPASSED') - 8 * count_if(verdict = 'DEGRADED')) >= 40 AS exportable FROM {audits} GROUP BY run"""

OPERATORS["component_confidence"] = """
WITH w AS (SELECT run, sum(weight * confidence) / sum(weight) AS c, min(CASE WHEN critical THEN confidence END) AS least_critical FROM {parts} GROUP BY run)
SELECT run, round(round(CASE WHEN least_critical < 7e-1 THEN least(c, least_critical) ELSE c END, 9), 6) AS overall FROM w"""

OPERATORS["flag_rates"] = """
SELECT source, count(*) AS n, round(avg(CASE WHEN flagged THEN 1e0 ELSE 0e0 END), 3) AS rate FROM {rows} GROUP BY source"""

# -- rewards and reviews ------------------------------------------------------------------------
#: candidates: grp, id, faithful, original, judged, fingerprint, bloom, simulation, path, penalty
OPERATORS["reward"] = """
SELECT grp, id, round(25e-2 * faithful + 15e-2 * original + 15e-2 * judged + 15e-2 * fingerprint + 1e-1 * bloom + 1e-1 * simulation + 1e-1 * path - 2e-1 * penalty, 6) AS reward FROM {candidates}"""

OPERATORS["group_advantage"] = """
WITH s AS (SELECT grp, avg(reward) AS mean, coalesce(stddev_pop(reward), 0e0) AS std FROM {rewards} GROUP BY grp)
SELECT r.grp, r.id, round(CASE WHEN s.std > 0 THEN (r.reward - s.mean) / s.std ELSE 0e0 END, 6) + 0e0 AS advantage FROM {rewards} r JOIN s ON r.grp = s.grp"""

OPERATORS["preference_pairs"] = """
WITH r AS (SELECT grp, id, reward, row_number() OVER (PARTITION BY grp ORDER BY reward DESC, id) AS best, row_number() OVER (PARTITION BY grp ORDER BY reward, id DESC) AS worst FROM {rewards})
SELECT a.grp, a.id AS chosen, b.id AS rejected FROM r a JOIN r b ON a.grp = b.grp AND a.best = 1 AND b.worst = 1 WHERE a.reward > b.reward"""

OPERATORS["call_log"] = """
SELECT kind, count(*) AS calls, round(avg(latency), 4) AS mean_latency, round(max(latency), 4) AS longest, round(avg(CASE WHEN failed THEN 1e0 ELSE 0e0 END), 4) AS failures FROM {calls} GROUP BY kind"""

OPERATORS["rule_counts"] = """
SELECT rule, count(*) AS fired, bool_or(critical) AS critical FROM {fires} GROUP BY rule"""

OPERATORS["raft_examples"] = """
SELECT id, topic, concat_ws(',', CAST(lead(id, 1) OVER w AS STRING), CAST(lead(id, 2) OVER w AS STRING), CAST(lead(id, 3) OVER w AS STRING)) AS distractors FROM {examples} WINDOW w AS (PARTITION BY topic ORDER BY id)"""

# -- joins ---------------------------------------------------------------------------------------
OPERATORS["hard_negative_pool"] = """
WITH big AS (SELECT subject FROM {items} GROUP BY subject HAVING count(*) >= 3)
SELECT q.id, lead(q.id) OVER (PARTITION BY q.subject, q.marks ORDER BY md5(CAST(q.id AS STRING)), q.id) AS negative FROM {items} q JOIN big ON q.subject = big.subject"""

OPERATORS["name_resolution"] = """
SELECT DISTINCT c.id AS src, t.id AS dst FROM {wanted} c JOIN {named} t ON lower(c.needs) = lower(t.name) WHERE c.id <> t.id"""

OPERATORS["plan_units"] = """
SELECT p.slot, coalesce(u.unit, (SELECT min(unit) FROM {units})) AS unit, u.unit IS NULL AS fallback FROM {slots} p LEFT JOIN {units} u ON p.concept = u.concept"""

OPERATORS["weighted_sample"] = """
WITH r AS (SELECT i.subject, i.id, w.share, row_number() OVER (PARTITION BY i.subject ORDER BY md5(CAST(i.id AS STRING)), i.id) AS rn FROM {items} i JOIN {weights} w ON i.subject = w.subject)
SELECT subject, id FROM r WHERE rn <= floor(share * {{n}} * 2)""".replace("{{n}}", "100")

OPERATORS["toc_ranges"] = """
WITH n AS (SELECT doc, title, page, lead(page) OVER (PARTITION BY doc ORDER BY page, title) AS after FROM {entries}),
r AS (SELECT doc, title, page AS first, coalesce(after - 1, 1000000) AS last FROM n)
SELECT r.doc, r.title, count(*) AS pages FROM r JOIN {pages} p ON p.doc = r.doc AND p.page BETWEEN r.first AND r.last GROUP BY r.doc, r.title"""

OPERATORS["page_offset"] = """
WITH o AS (SELECT doc, pdf - printed AS off, count(*) AS n FROM {pages} GROUP BY doc, pdf - printed),
m AS (SELECT doc, off FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, off) AS rn FROM o) x WHERE rn = 1)
SELECT doc, off FROM m"""

OPERATORS["nearest_above"] = """
SELECT doc, id, max(CASE WHEN kind = 'head' THEN id END) OVER (PARTITION BY doc ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM {blocks}"""

OPERATORS["rows_without_source"] = """
SELECT o.page, o.id FROM {ocr} o LEFT JOIN (SELECT DISTINCT page FROM {native}) n ON o.page = n.page WHERE n.page IS NULL
UNION ALL SELECT page, id FROM {native}"""

#: samples: id, level, kind; stage: level, kind. One match is enough.
OPERATORS["curriculum_filter"] = """
SELECT s.id FROM {samples} s LEFT JOIN (SELECT DISTINCT level FROM {stage}) l ON s.level = l.level LEFT JOIN (SELECT DISTINCT kind FROM {stage}) k ON s.kind = k.kind WHERE l.level IS NOT NULL OR k.kind IS NOT NULL"""

#: rows: id, status, score
OPERATORS["export_rows"] = """
SELECT id, status FROM {rows} WHERE coalesce(status, 'pending') NOT IN ('flagged', 'pending') AND (coalesce(score, 0e0) >= 85e-2 OR status = 'approved')"""

#: hits: query, id, score; rows: id, module. Module empty or the query's own.
OPERATORS["hit_rows"] = """
SELECT h.query, h.id, r.module FROM {hits} h JOIN {rows} r ON h.id = r.id WHERE r.module IS NULL OR r.module = '' OR r.module = h.module"""

OPERATORS["merged_lists"] = """
WITH f AS (SELECT grp, item, min(seq) AS met FROM {lists} GROUP BY grp, item)
SELECT grp, <<joined item '|' met>> AS items FROM f GROUP BY grp"""

#: real, made: field (verb, level, marks), name. Cosine of each field's counts, weighed 0.5, 0.25, 0.25.
OPERATORS["style_similarity"] = """
WITH r AS (SELECT field, name, CAST(count(*) AS DOUBLE) AS n FROM {real} GROUP BY field, name), m AS (SELECT field, name, CAST(count(*) AS DOUBLE) AS n FROM {made} GROUP BY field, name),
b AS (SELECT coalesce(r.field, m.field) AS field, coalesce(r.n, 0e0) AS x, coalesce(m.n, 0e0) AS y FROM r FULL OUTER JOIN m ON r.field = m.field AND r.name = m.name),
c AS (SELECT field, CASE WHEN sum(x * x) > 0 AND sum(y * y) > 0 THEN sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) ELSE 0e0 END AS cosine FROM b GROUP BY field)
SELECT round(sum(cosine * CASE field WHEN 'verb' THEN 5e-1 ELSE 25e-2 END), 6) AS similarity FROM c"""

OPERATORS["marks_by_weight"] = """
SELECT grp, id, round(total * weight / sum(weight) OVER (PARTITION BY grp), 4) AS marks FROM {weights}"""

#: Questions take two topics each, going round: those least used so far.
OPERATORS["topic_allocation"] = """
WITH t AS (SELECT subject, topic, row_number() OVER (PARTITION BY subject ORDER BY topic) - 1 AS at, count(*) OVER (PARTITION BY subject) AS n FROM {topics}),
q AS (SELECT subject, question, explode(sequence(0, 1)) AS j FROM {questions})
SELECT q.subject, q.question, t.topic FROM q JOIN t ON q.subject = t.subject AND (2 * (q.question - 1) + q.j) % t.n = t.at"""

#: candidates: grp, id, aligned, covered, required, capital, ended, fits, verb_first, novelty, style
OPERATORS["question_ranking"] = """
WITH s AS (SELECT *, CASE WHEN required > 0 THEN covered / CAST(required AS DOUBLE) ELSE 8e-1 END AS coverage FROM {candidates}),
o AS (SELECT grp, id, NOT aligned OR coverage < 2e-1 AS out, CASE WHEN NOT aligned THEN 9e-2 WHEN coverage < 2e-1 THEN 3e-1 + 25e-2 * coverage ELSE 3e-1 + 25e-2 * coverage + 2e-1 * 25e-2 * (capital + ended + fits + verb_first) + 15e-2 * novelty + 1e-1 * style END AS overall FROM s)
SELECT grp, id, out, round(overall, 6) AS overall, CAST(row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN out THEN 1 ELSE 0 END, round(overall, 9) DESC, id) AS INT) AS place FROM o"""
OPERATORS["best_question"] = "SELECT grp, id, overall FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY place) AS rn FROM {ranked} WHERE NOT out AND overall >= 3e-1) x WHERE rn = 1"

#: retrieved: query, chunks, words, academic, coverage, overlap
OPERATORS["retrieval_gate"] = """
WITH r AS (SELECT *, CASE WHEN chunks = 0 THEN 'EMPTY_RETRIEVAL' WHEN chunks < 2 THEN 'BELOW_MIN_CHUNKS' WHEN words < 60 THEN 'THIN_CONTEXT' WHEN academic < 3 THEN 'LOW_ACADEMIC' WHEN coverage < 5e-1 THEN 'ENTITY_MISMATCH' ELSE 'PASSED_GATE' END AS reason FROM {retrieved})
SELECT query, reason, round(CASE WHEN reason = 'PASSED_GATE' THEN 5e-1 * overlap + 3e-1 * least(1e0, academic / 10e0) + 2e-1 * least(1e0, chunks / 5e0) ELSE 0e0 END, 6) AS score FROM r"""

#: rows: id, copied (share of words from the source), banked (share from the question bank), faithful
OPERATORS["guardrails"] = """
SELECT id, copied <= 8e-1 AS original, banked <= 75e-2 AS fresh, copied <= 8e-1 AND banked <= 75e-2 AND faithful AS passed FROM {rows}"""

OPERATORS["inverted_index"] = """
SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY id) AS place FROM (SELECT DISTINCT topic, id FROM {items}) x"""

OPERATORS["answer_coverage"] = """
SELECT count(*) AS concepts, round(avg(CASE WHEN a.concept IS NULL THEN 0e0 ELSE 1e0 END), 4) AS coverage, round(avg(a.quality), 4) AS quality FROM {concepts} c LEFT JOIN {answers} a ON c.concept = a.concept"""

OPERATORS["readiness"] = """
SELECT grp, bool_and(done) AND count_if(failed) = 0 AS ready FROM {files} GROUP BY grp"""

OPERATORS["conflicts"] = """
SELECT grp, count(DISTINCT subject) AS subjects, count(DISTINCT subject) > 1 AS conflict FROM {files} GROUP BY grp"""

OPERATORS["status_machine"] = """
WITH s AS (SELECT doc, seq, status, lag(status) OVER (PARTITION BY doc ORDER BY seq) AS was FROM {moves})
SELECT doc, max_by(status, seq) AS status, count_if(NOT (was IS NULL OR (was = 'registered' AND status IN ('extracting', 'failed')) OR (was = 'extracting' AND status IN ('extracted', 'failed')) OR (was = 'extracted' AND status IN ('ready', 'failed')))) AS forbidden
FROM s GROUP BY doc"""

#: signals: concept, seq, understand, compare, explain. A pass moves a concept on by one stage at most, in order.
OPERATORS["stage_progress"] = """
WITH a AS (SELECT *, min(CASE WHEN understand >= 4e-1 THEN seq END) OVER (PARTITION BY concept) AS t1 FROM {signals}),
b AS (SELECT *, min(CASE WHEN seq > t1 AND understand >= 65e-2 THEN seq END) OVER (PARTITION BY concept) AS t2 FROM a),
c AS (SELECT *, min(CASE WHEN seq > t2 AND compare >= 5e-1 THEN seq END) OVER (PARTITION BY concept) AS t3 FROM b),
d AS (SELECT *, min(CASE WHEN seq > t3 AND explain >= 7e-1 THEN seq END) OVER (PARTITION BY concept) AS t4 FROM c)
SELECT concept, CASE WHEN max(t4) IS NOT NULL THEN 'explainable' WHEN max(t3) IS NOT NULL THEN 'connected' WHEN max(t2) IS NOT NULL THEN 'understood' WHEN max(t1) IS NOT NULL THEN 'recognised' ELSE 'unseen' END AS stage, max(seq) AS passes FROM d GROUP BY concept"""

OPERATORS["promotion"] = """
SELECT coalesce(a.metric, b.metric) AS metric, round(coalesce(b.v, 0e0) - coalesce(a.v, 0e0), 4) AS difference, NOT (coalesce(a.metric, b.metric) = 'overall_score' AND coalesce(b.v, 0e0) < coalesce(a.v, 0e0)) AS allowed
FROM {before} a FULL OUTER JOIN {after} b ON a.metric = b.metric"""

OPERATORS["replace_epoch"] = """
SELECT o.epoch, o.v FROM {old} o LEFT JOIN (SELECT DISTINCT epoch FROM {new}) n ON o.epoch = n.epoch WHERE n.epoch IS NULL UNION ALL SELECT epoch, v FROM {new}"""

OPERATORS["ordered_distinct"] = """
SELECT grp, name, min(seq) AS first FROM {items} GROUP BY grp, name"""

OPERATORS["provenance"] = """
SELECT id, round(CASE WHEN refs THEN 5e-1 ELSE 0e0 END + CASE WHEN caption THEN 25e-2 ELSE 0e0 END + CASE WHEN words > 3 THEN 1e-1 ELSE 0e0 END + CASE WHEN section THEN 1e-1 ELSE 0e0 END + CASE WHEN typed THEN 5e-2 ELSE 0e0 END, 4) AS score FROM {figures}"""

OPERATORS["slot_order"] = """
SELECT module, name, CAST(row_number() OVER (PARTITION BY module ORDER BY round(importance * 6e-1 + least(frequency / 20e0, 1e0) * 4e-1, 9) DESC, name) AS INT) AS place FROM {concepts}"""

OPERATORS["longest_chunks"] = """
SELECT module, id, words FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY words DESC, id) AS rn FROM {chunks}) x WHERE rn <= 3"""

OPERATORS["chunk_images"] = """
SELECT module, count(*) AS chunks, count_if(images > 0) AS with_images, round(100e0 * count_if(images > 0) / count(*), 1) AS coverage FROM {chunks} GROUP BY module"""

OPERATORS["edge_changes"] = """
SELECT src, dst FROM (SELECT src, dst FROM {edges} UNION SELECT src, dst FROM {added} UNION SELECT dst, src FROM {added}) x
EXCEPT SELECT src, dst FROM {removed}"""

OPERATORS["rollback"] = """
SELECT a.subject, a.version, p.version AS parent FROM {versions} a JOIN {versions} p ON a.subject = p.subject AND p.version = a.parent WHERE a.active"""

OPERATORS["union_sources"] = """
SELECT 'db' AS origin, id, text FROM {db} UNION ALL SELECT 'curated' AS origin, id, text FROM {curated}"""

OPERATORS = {k: v.replace("split_words(lower(coalesce(text, '')))", r"regexp_extract_all(lower(coalesce(text, '')), r'[^\s]+', 0)") for k, v in OPERATORS.items()}
