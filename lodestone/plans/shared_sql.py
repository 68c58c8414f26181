"""Relational operators as SQL that Spark and DuckDB share. Tables stand in braces; two macros differ by engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {}

# -- upserts, samples, splits ---------------------------------------------------
SQL["upsert_last_wins"] = """
SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) x
WHERE rn = 1"""

SQL["reencounter_confidence"] = """
SELECT md5(lower(trim(coalesce(text, '')))) AS content, min(doc_id) AS first_doc, count(*) AS times,
       round(least(1e0, 5e-1 + 1e-1 * (count(*) - 1)), 4) AS confidence
FROM {documents} GROUP BY md5(lower(trim(coalesce(text, ''))))"""

SQL["frequency_upsert"] = """
SELECT event_type, CAST(sum(n) AS BIGINT) AS frequency FROM (
  SELECT event_type, 1 AS n FROM {events} WHERE event_id % 2 = 0
  UNION ALL SELECT event_type, 1 AS n FROM {events} WHERE event_id % 2 = 1) x
GROUP BY event_type"""

SQL["split_80_10_10"] = """
SELECT doc_id, CASE WHEN substr(md5(CAST(doc_id AS STRING)), 1, 4) < 'cccd' THEN 'train'
                    WHEN substr(md5(CAST(doc_id AS STRING)), 1, 4) < 'e666' THEN 'validation' ELSE 'test' END AS part
FROM {documents}"""

SQL["group_sample"] = """
SELECT lang, doc_id, CAST(rn AS BIGINT) AS place FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS rn FROM {documents}) x
WHERE rn <= 20"""

SQL["replay_mix"] = """
WITH fresh AS (SELECT doc_id FROM {labels} WHERE quality = 1),
old AS (SELECT doc_id FROM {labels} WHERE quality = 0 AND toxic = 0),
want AS (SELECT CAST(floor(count(*) * 3e-1 / 7e-1) AS BIGINT) AS n FROM fresh),
hashed AS (SELECT doc_id, md5(CAST(doc_id AS STRING)) AS h FROM old),
slots AS (SELECT substr(h, 1, 3) AS slot, count(*) AS c FROM hashed GROUP BY substr(h, 1, 3)),
before AS (SELECT slot, sum(c) OVER (ORDER BY slot) - c AS met FROM slots),
ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY substr(h, 1, 3) ORDER BY h, doc_id) + met AS rn FROM hashed JOIN before ON substr(h, 1, 3) = slot)
SELECT doc_id, 'new' AS origin FROM fresh
UNION ALL SELECT doc_id, 'replay' AS origin FROM ranked JOIN want ON rn <= n"""

SQL["registry_single_active"] = """
SELECT user_id, event_id, event_id = max(event_id) OVER (PARTITION BY user_id) AS is_production
FROM {events} WHERE event_type = 'signup'"""

SQL["running_best_activation"] = """
SELECT user_id, event_id, round(value, 6) AS value, coalesce(value > best, TRUE) AS activated FROM (
  SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {events}) x"""

SQL["version_history"] = """
SELECT user_id, event_id, event_type, CAST(row_number() OVER w AS BIGINT) AS version, <<epoch ts>> AS valid_from, lead(<<epoch ts>>) OVER w AS valid_to
FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""

# -- aggregates ------------------------------------------------------------------
SQL["export_manifest"] = """
SELECT lang, source, count(*) AS samples, round(avg(CAST(quality AS DOUBLE)), 6) AS mean_quality, CAST(sum(toxic) AS BIGINT) AS toxic
FROM {documents} JOIN {labels} USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))"""

SQL["export_filter"] = """
SELECT d.doc_id, d.lang, d.source FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.toxic = 0 AND l.quality = 1"""

SQL["group_counts"] = """
SELECT 'lang' AS field, lang AS name, count(*) AS n FROM {documents} GROUP BY lang
UNION ALL SELECT 'source' AS field, source AS name, count(*) AS n FROM {documents} GROUP BY source"""

SQL["metric_compare"] = """
WITH old AS (SELECT lang AS metric, avg(CAST(n_chars AS DOUBLE)) AS v FROM {documents} WHERE doc_id % 2 = 0 GROUP BY lang),
new AS (SELECT lang AS metric, avg(CAST(n_chars AS DOUBLE)) AS v FROM {documents} WHERE doc_id % 2 = 1 AND lang <> 'de' GROUP BY lang)
SELECT coalesce(o.metric, n.metric) AS metric, round(coalesce(n.v, 0e0) - coalesce(o.v, 0e0), 4) AS difference
FROM old o FULL OUTER JOIN new n ON o.metric = n.metric"""

SQL["softmax_kind"] = """
WITH scored AS (
  SELECT doc_id, 'table' AS kind, CASE WHEN text LIKE '%|%' THEN 2e0 ELSE 0e0 END AS s FROM {documents}
  UNION ALL SELECT doc_id, 'prose' AS kind, CASE WHEN text LIKE '%. %' THEN 15e-1 ELSE 0e0 END AS s FROM {documents}
  UNION ALL SELECT doc_id, 'code' AS kind, CASE WHEN text LIKE '%=%' THEN 1e0 ELSE 0e0 END AS s FROM {documents}),
raised AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM scored)
SELECT doc_id, kind, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS p FROM raised"""

SQL["majority_vote"] = """
SELECT source, lang, n, round(share, 6) AS share FROM (
  SELECT source, lang, n, n * 1e0 / sum(n) OVER (PARTITION BY source) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn
  FROM (SELECT source, lang, count(*) AS n FROM {documents} GROUP BY source, lang) c) x
WHERE rn = 1 AND share >= 6e-1"""

# -- joins -----------------------------------------------------------------------
SQL["alias_canonical"] = """
WITH alias AS (SELECT * FROM (VALUES ('Brand#11', 'first'), ('Brand#12', 'first'), ('Brand#21', 'second')) AS t(name, canonical))
SELECT coalesce(a.canonical, p.p_brand) AS brand, count(*) AS n FROM {part} p LEFT JOIN alias a ON p.p_brand = a.name
GROUP BY coalesce(a.canonical, p.p_brand)"""

SQL["two_hop_strength"] = """
WITH edges AS (
  SELECT l_partkey % 97 AS src, l_suppkey % 97 AS dst, round(least(1e0, count(*) / 50e0), 4) AS s FROM {lineitem}
  WHERE l_partkey % 97 <> l_suppkey % 97 GROUP BY l_partkey % 97, l_suppkey % 97)
SELECT a.src, b.dst, round(max(a.s * b.s * 5e-1), 4) AS strength FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY a.src, b.dst"""

SQL["integrity_orphans"] = """
SELECT l_orderkey, count(*) AS n FROM {lineitem} l LEFT JOIN {orders} o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus <> 'P'
WHERE o.o_orderkey IS NULL GROUP BY l_orderkey"""

SQL["range_join_shipping"] = """
SELECT o.o_orderkey, count(*) AS shipped_soon FROM {orders} o JOIN {lineitem} l
  ON o.o_orderkey = l.l_orderkey AND <<epoch l_shipdate>> BETWEEN <<epoch o_orderdate>> AND <<epoch o_orderdate>> + 30 * 86400
GROUP BY o.o_orderkey"""

SQL["asof_view_before_purchase"] = """
SELECT event_id, user_id, bought, seen FROM (
  SELECT event_id, user_id, event_type, <<epoch ts>> AS bought,
         max(CASE WHEN event_type = 'view' THEN <<epoch ts>> END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM {events}) x WHERE event_type = 'purchase'"""

# -- windows and state -------------------------------------------------------------
SQL["gap_detection"] = """
SELECT user_id, event_id, gap FROM (
  SELECT user_id, event_id, lead(<<epoch ts>>) OVER (PARTITION BY user_id ORDER BY ts, event_id) - <<epoch ts>> AS gap FROM {events}) x WHERE gap > 86400"""

SQL["ema_confidence"] = """
WITH n AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {events})
SELECT user_id, max(n) AS updates, round(sum(3e-1 * value * power(7e-1, n - i)), 6) AS confidence FROM n GROUP BY user_id"""

SQL["stage_machine"] = """
WITH points AS (
  SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS stage FROM {events})
SELECT user_id, event_id, max(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stage FROM points"""

SQL["queue_claim"] = """
SELECT o_orderpriority AS lane, o_orderkey AS job FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM {orders} WHERE o_orderstatus = 'O') x WHERE rn = 1"""

SQL["log_tail"] = """SELECT event_id AS seq, event_type AS message FROM {events} WHERE event_id > 900 AND event_type = 'error'"""

SQL["status_latest"] = """
SELECT user_id, event_type AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events} WHERE event_type <> 'view') x WHERE rn = 1"""

SQL["adjacent_pairs"] = """
SELECT conv_id, turn, text AS anchor, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS positive FROM {conversations}"""

# -- papers, marks, slots ------------------------------------------------------------
SQL["paper_attemptable_marks"] = """
WITH q AS (SELECT l_orderkey AS paper, l_linenumber AS mq, sum(l_quantity) AS marks FROM {lineitem} GROUP BY l_orderkey, l_linenumber),
pairs AS (SELECT paper, floor((mq - 1) / 2) AS pair, max(marks) AS best FROM q GROUP BY paper, floor((mq - 1) / 2))
SELECT paper, round(sum(best), 4) AS attemptable FROM pairs GROUP BY paper"""

SQL["or_parity_violations"] = """
WITH q AS (SELECT l_orderkey AS paper, l_linenumber AS mq, sum(l_quantity) AS marks FROM {lineitem} GROUP BY l_orderkey, l_linenumber)
SELECT paper, CAST(floor((mq - 1) / 2) AS BIGINT) AS pair, count(DISTINCT marks) AS totals FROM q GROUP BY paper, floor((mq - 1) / 2) HAVING count(DISTINCT marks) > 1"""

SQL["bloom_mark_share"] = """
SELECT l_orderkey AS paper, round(100 * sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / sum(l_quantity), 2) AS low_share,
       sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) < 15e-2 AS too_few_high FROM {lineitem} GROUP BY l_orderkey"""

SQL["missing_outcomes"] = """
WITH want AS (SELECT paper, <<each 1 5>> AS n FROM (SELECT DISTINCT l_orderkey AS paper FROM {lineitem}) p)
SELECT w.paper, w.n AS missing FROM want w LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM {lineitem}) l
  ON w.paper = l.l_orderkey AND w.n = l.l_linenumber WHERE l.l_orderkey IS NULL"""

SQL["largest_remainder"] = """
WITH w AS (
  SELECT l_orderkey AS paper, l_linenumber AS part, 100 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey) AS exact FROM {lineitem}
  GROUP BY l_orderkey, l_linenumber),
f AS (SELECT *, floor(exact) AS low, 100 - sum(floor(exact)) OVER (PARTITION BY paper) AS spare,
             row_number() OVER (PARTITION BY paper ORDER BY round(exact - floor(exact), 9) DESC, part) AS rn FROM w)
SELECT paper, part, CAST(low + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS BIGINT) AS marks FROM f"""

SQL["coverage_diversity"] = """
SELECT l_orderkey AS paper, round((count(DISTINCT l_returnflag) / 6e0 + count(DISTINCT l_linestatus) / 5e0 + least(1e0, count(DISTINCT l_suppkey) / 5e0)) / 3, 6) AS diversity
FROM {lineitem} GROUP BY l_orderkey"""

SQL["slot_fill"] = """
WITH ranked AS (
  SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM {part}),
slots AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS s(slot))
SELECT r.p_brand, s.slot, r.p_partkey FROM slots s JOIN ranked r ON r.rn = least(s.slot, r.n - 1)"""

SQL["template_frequency"] = """
SELECT p_type AS template, count(*) AS n FROM {part} GROUP BY p_type ORDER BY n DESC, template LIMIT 500"""

SQL["cube_sales"] = """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)"""

SQL["top_customers"] = """
SELECT n_name, c_custkey, round(total, 2) AS total FROM (
  SELECT n.n_name, c.c_custkey, sum(o.o_totalprice) AS total, row_number() OVER (PARTITION BY n.n_name ORDER BY sum(o.o_totalprice) DESC, c.c_custkey) AS rn
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, c.c_custkey) x WHERE rn <= 3"""

SQL["term_set_difference"] = """
SELECT p_name || ' ' || p_brand AS term FROM {part} WHERE p_size > 25 EXCEPT SELECT p_name || ' ' || p_brand AS term FROM {part} WHERE p_size <= 25"""

SQL["term_set_common"] = """
SELECT p_name || ' ' || p_brand AS term FROM {part} WHERE p_size > 25 INTERSECT SELECT p_name || ' ' || p_brand AS term FROM {part} WHERE p_size <= 25"""

SQL["health_ledger"] = """
WITH costs AS (SELECT * FROM (VALUES ('error', 15), ('view', 1)) AS t(kind, cost))
SELECT user_id, greatest(0, 100 - CAST(sum(coalesce(cost, 0)) AS BIGINT)) AS score, sum(coalesce(cost, 0)) <= 60 AS exportable
FROM {events} LEFT JOIN costs ON event_type = kind GROUP BY user_id"""

SQL["qa_report_score"] = """
WITH penalty AS (SELECT * FROM (VALUES ('R', 5), ('A', 15)) AS t(flag, points))
SELECT l_orderkey AS paper, greatest(0, least(100, 100 - CAST(sum(coalesce(points, 0)) AS BIGINT))) AS score
FROM {lineitem} LEFT JOIN penalty ON l_returnflag = flag GROUP BY l_orderkey"""

SQL["coverage_by_type"] = """
SELECT l_returnflag AS kind, count(*) AS parts, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS share FROM {lineitem} GROUP BY l_returnflag"""

SQL["preferred_verb"] = """
WITH n AS (
  SELECT p_size AS marks, p_brand AS verb, count(*) AS frequency, min(p_partkey) AS met FROM {part} GROUP BY p_size, p_brand)
SELECT marks, verb, frequency FROM (SELECT *, row_number() OVER (PARTITION BY marks ORDER BY frequency DESC, met) AS rn FROM n) x WHERE rn = 1"""

SQL["monotonous_verbs"] = """
WITH n AS (SELECT l_orderkey AS paper, l_returnflag AS verb, count(*) AS uses, sum(count(*)) OVER (PARTITION BY l_orderkey) AS total FROM {lineitem} GROUP BY l_orderkey, l_returnflag)
SELECT paper, verb, round(uses * 1e0 / total, 4) AS share FROM n WHERE uses * 2 > total AND total >= 4"""

SQL["acceptance_rates"] = """
SELECT source, round(sum(quality) * 1e0 / count(*), 4) AS accepted, round(sum(toxic) * 1e0 / count(*), 4) AS flagged
FROM {documents} JOIN {labels} USING (doc_id) GROUP BY source"""

# -- graphs ------------------------------------------------------------------------
SQL["typed_edges"] = """
SELECT DISTINCT n.n_nationkey AS src, r.r_regionkey AS dst, 'part_of' AS relation FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey"""

_EPOCH = re.compile(r"<<epoch (\w+)>>")


_EACH = re.compile(r"<<each (\d+) (\d+)>>")


def spark_text(text: str) -> str:
    text = _EACH.sub(r"explode(sequence(\1, \2))", text)
    return _EPOCH.sub(r"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))", text)


def duck_text(text: str) -> str:
    text = _EACH.sub(r"unnest(generate_series(\1, \2))", text)
    text = _EPOCH.sub(r"date_diff('second', TIMESTAMP '1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP))", text)
    return re.sub(r"\{(\w+)\}", r"\1", text)


def query(name: str):
    text = spark_text(SQL[name])
    tables = set(re.findall(r"\{(\w+)\}", text))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    return run


QUERIES = {name: query(name) for name in SQL}
ORACLE_SQL = {name: duck_text(text) for name, text in SQL.items()}
