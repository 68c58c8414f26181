"""Queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balls, chats, hpylm, infill, lines, mixing, nearest, packing, pii, quality, simhash, suffixes, tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(_read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3)
    return made.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.dedup_lines(_read(spark, sf_dir, "documents"))
    kept = F.sha2(F.encode(F.coalesce("kept_text", F.lit("")), "UTF-8"), 256)
    return made.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_spans", kept.alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.find(_read(spark, sf_dir, "documents"))
    counts = [_of_kind(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return made.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def _of_kind(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.judge(_read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.cluster(_read(spark, sf_dir, "embeddings"))


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chats.read_back(chats.windows(rows))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restore(infill.transform(_read(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", infill.digest(F.col("output")).alias("output_sha256"), infill.digest(F.col("restored")).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_hpylm, op2_simhash, op3_nearest, op4_token_counts, op5_suffix_dedup, op6_mixing, op7_line_dedup, op8_pii, op9_packing, op10_quality, op11_ball_kmeans, op12_chat_windows, op13_infill)
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op6_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sources),
leveled AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS level FROM weighed),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS fill
  FROM leveled WINDOW before AS (ORDER BY level, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, least(weight * (SELECT max(fill) FROM filled), 3.0::DOUBLE * source_size) AS target
  FROM filled),
based AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS base FROM goals),
summed AS (
  SELECT d.doc_id, d.size, d.h, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized d JOIN based b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (base + CASE WHEN budget <= 0 THEN 0 WHEN upto + 0.5 < budget THEN 1
         WHEN upto - size + 0.5 < budget AND (budget - (upto - size)) * 2 >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""

ORACLE_SQL["op7_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (
  SELECT doc_id, i, regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x
  FROM split, unnest(range(1, len(ls) + 1)) AS r(i)),
numbered AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM line WHERE x <> ''),
window3 AS (
  SELECT doc_id, k, x AS a, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
first AS (
  SELECT a, b, c, min((doc_id, k)) AS f FROM window3 WHERE c IS NOT NULL GROUP BY a, b, c HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT w.doc_id, unnest(range(CASE WHEN f[1] = w.doc_id THEN greatest(w.k, f[2] + 3) ELSE w.k END, w.k + 3)) AS k
  FROM window3 w JOIN first USING (a, b, c) WHERE (w.doc_id, w.k) > f),
marked AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p IS NULL OR p <> k - 1) AS n_spans
  FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM gone) GROUP BY doc_id),
kept AS (
  SELECT s.doc_id, string_agg(s.ls[r.i], chr(10) ORDER BY r.i) AS text
  FROM split s, unnest(range(1, len(s.ls) + 1)) AS r(i)
  LEFT JOIN (SELECT g.doc_id, n.i FROM gone g JOIN numbered n USING (doc_id, k)) g ON g.doc_id = s.doc_id AND g.i = r.i
  WHERE g.i IS NULL GROUP BY s.doc_id),
counted AS (
  SELECT doc_id, count(*) AS n_lines FROM numbered GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split s LEFT JOIN counted USING (doc_id) LEFT JOIN marked USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_ROUNDS = 10


def _kmeans_sql() -> str:
    """Ten assignments and updates written out, one after the other; x: row, component, value."""
    parts = ["""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
x AS MATERIALIZED (SELECT row, unnest(range(1, 65)) AS i, unnest(x) AS v FROM kept),
c0 AS MATERIALIZED (
  SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS v
  FROM (SELECT x, CAST(row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS INT) AS c FROM kept) WHERE c < 8)"""]
    for k in range(_ROUNDS + 1):
        parts.append(f"""d{k} AS MATERIALIZED (
  SELECT row, c, d FROM (
    SELECT row, c, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{k} c USING (i) GROUP BY row, c)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1)""")
        if k < _ROUNDS:
            parts.append(f"""s{k} AS (SELECT c, i, sum(v) AS s, CAST(count(*) AS HUGEINT) AS n FROM d{k} JOIN x USING (row) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (SELECT c, i, CAST(coalesce((s - ((s % n) + n) % n) // n, v) AS BIGINT) AS v FROM c{k} LEFT JOIN s{k} USING (c, i))""")
    k = _ROUNDS
    return ",\n".join(parts) + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM d{k} JOIN kept USING (row) JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{k} GROUP BY c) USING (c)
"""


ORACLE_SQL["op11_ball_kmeans"] = _kmeans_sql()

ORACLE_SQL["op13_infill"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
