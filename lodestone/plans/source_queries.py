"""Queries over validated JSON, stored vectors, office files and samples kept of streams, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve
from ..sources import office, validated, vectors
from ..sources.shared import work_path
from ..streaming import events as E
from ..streaming import reservoir
from .text_queries import PAIRS_SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


DOCUMENT = {
    "type": "object", "required": ["doc_id", "text", "meta"],
    "properties": {
        "doc_id": {"type": "integer", "minimum": 10},
        "text": {"type": "string", "minLength": 400, "pattern": "[.!?]"},
        "meta": {"type": "object", "required": ["lang"], "properties": {"lang": {"enum": ["en", "fr", "de"]}, "source": {"type": "string", "pattern": "[13579]$"}}},
        "lines": {"type": "array", "maxItems": 12, "items": {"type": "string", "maxLength": 900}},
    },
}


def validated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON under a schema; a rule over two fields besides."""
    docs = _read(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    text = F.to_json(F.struct("doc_id", "text", F.struct("lang", "source").alias("meta"), lines.alias("lines")))
    made = validated.judged(docs.select("doc_id", text.alias("json")), "json", DOCUMENT, {"short lines": "length(sample.text) <= 400 * size(sample.lines)"})
    return made.select("doc_id", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), F.length("sample.text").alias("chars"))


PART = {"type": "object", "required": ["letter", "marks", "level"], "properties": {"letter": {"type": "string", "pattern": "^[a-z]$"}, "marks": {"type": "integer", "minimum": 2, "maximum": 45}, "level": {"type": "string", "enum": ["L1", "L2", "L3", "L4", "L5", "L6"]}}}
PAPER = {"type": "object", "required": ["paper", "parts"], "properties": {"paper": {"type": "integer"}, "choice": {"type": "boolean"}, "parts": {"type": "array", "minItems": 2, "maxItems": 7, "items": PART}}}
PAPER_RULES = {
    "letters follow each other": "sample.parts.letter = transform(sequence(0, size(sample.parts) - 1), i -> char(97 + i))",
    "a choice has equal marks": "NOT sample.choice OR array_size(array_distinct(sample.parts.marks)) = 1",
    "half are of level 2 or 3": "2 * size(filter(sample.parts, p -> p.level IN ('L2', 'L3'))) >= size(sample.parts)",
}


def validated_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a paper, its lines are parts, lettered by line number."""
    lines = _read(spark, sf_dir, "lineitem")
    part = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(F.char(F.col("l_linenumber") + 96).alias("letter"), F.col("l_quantity").cast("int").alias("marks"), F.concat(F.lit("L"), (F.col("l_suppkey") % 6 + 1).cast("string")).alias("level")).alias("p"))
    papers = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["p"]).alias("parts"))
    text = F.to_json(F.struct(F.col("l_orderkey").alias("paper"), (F.col("l_orderkey") % 5 == 0).alias("choice"), "parts"))
    made = validated.judged(papers.select("l_orderkey", text.alias("json")), "json", PAPER, PAPER_RULES)
    return made.select("l_orderkey", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


def vector_index_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the vectors with odd ids, to which the others are appended; its 5 nearest, from a similarity of 0.2 on."""
    base, path = _read(spark, sf_dir, "embeddings"), work_path(spark, "index")
    vectors.build(base.where("vec_id % 2 = 1"), path)
    vectors.append(base.where("vec_id % 2 = 0"), path)
    return vectors.search(base.where("vec_id % 50 = 0"), path, 5, at_least=0.2).select("q_id", "vec_id", "sim", "rank")


def hard_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor's positive is the row with the next id; bounds at which both kinds of pairs occur."""
    base = _read(spark, sf_dir, "embeddings")
    pairs = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("anchor"), (F.col("vec_id") + 1).alias("positive"))
    return retrieve.hard_negatives(pairs, base, 0.3, 0.6)


def _as_docx(text: str | None) -> bytes:
    """A .docx with a paragraph a line, the first of them a heading."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    style = lambda i: "" if i else '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(f"<w:p>{style(i)}<w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for i, line in enumerate((text or "").split("\n")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def office_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, made into Word files by Spark and read back: blocks by kind, words and what is said of the file."""
    import pyarrow as pa

    def write(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_as_docx(t) for t in b.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    docs = _read(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text")
    made = office.blocks(docs.mapInArrow(write, "path string, content binary"))
    counts = made.groupBy("path").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "text").alias("paragraphs"))
    each = office.documents(made).join(counts, "path")
    return each.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("doc_id"), "headings", "paragraphs", "n_words", "tables", "confidence", "reason")


def stream_replay_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events come in several files, one a batch; of each type 20 are kept."""
    base = work_path(spark, "replay")
    _read(spark, sf_dir, "events").select("event_id", "event_type", "user_id").repartition(3, "event_id").write.parquet(f"{base}/in")
    buffer = reservoir.ReplayBuffer(f"{base}/buffer", ["event_type"], "event_id", 20)
    buffer.run(E.file_stream(spark, f"{base}/in", 1))
    made = buffer.read(spark)
    return made if made is not None else spark.read.parquet(f"{base}/in")


QUERIES = {f.__name__: f for f in (validated_documents, validated_papers, vector_index_appended, office_documents, stream_replay_buffer, hard_negative_pairs)}

ORACLE_SQL = {
    "validated_documents": r"""
WITH d AS (SELECT *, string_split(text, chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, text, ls, list_filter([
  CASE WHEN doc_id < 10 THEN 'doc_id:minimum' END, CASE WHEN text IS NULL THEN 'text:required' END, CASE WHEN length(text) < 400 THEN 'text:minLength' END,
  CASE WHEN NOT regexp_matches(text, '[.!?]') THEN 'text:pattern' END, CASE WHEN lang IS NULL THEN 'meta.lang:required' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'meta.lang:enum' END,
  CASE WHEN NOT regexp_matches(source, '[13579]$') THEN 'meta.source:pattern' END, CASE WHEN len(ls) > 12 THEN 'lines:maxItems' END, CASE WHEN len(list_filter(ls, lambda x: length(x) > 900)) > 0 THEN 'lines[]:maxLength' END], lambda x: x IS NOT NULL) AS rs FROM d)
SELECT doc_id, CASE WHEN len(rs) = 0 AND length(text) > 400 * len(ls) THEN 'short lines' ELSE coalesce(array_to_string(list_sort(rs), ','), '') END AS reasons, CASE WHEN len(rs) = 0 THEN length(text) END AS chars FROM r
""",
    "validated_papers": r"""
WITH p AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT CAST(l_quantity AS INT)) AS marks, min(l_quantity) AS lo, max(l_quantity) AS hi, list(l_linenumber ORDER BY l_linenumber) AS nums,
  count(*) FILTER (l_suppkey % 6 IN (1, 2)) AS mid FROM lineitem GROUP BY l_orderkey),
s AS (SELECT *, list_filter([CASE WHEN n < 2 THEN 'parts:minItems' END, CASE WHEN n > 7 THEN 'parts:maxItems' END, CASE WHEN lo < 2 THEN 'parts[].marks:minimum' END, CASE WHEN hi > 45 THEN 'parts[].marks:maximum' END], lambda x: x IS NOT NULL) AS rs FROM p),
t AS (SELECT *, list_filter([CASE WHEN nums <> range(1, n + 1) THEN 'letters follow each other' END, CASE WHEN l_orderkey % 5 = 0 AND marks > 1 THEN 'a choice has equal marks' END, CASE WHEN 2 * mid < n THEN 'half are of level 2 or 3' END], lambda x: x IS NOT NULL) AS broken FROM s)
SELECT l_orderkey, coalesce(array_to_string(list_sort(CASE WHEN len(rs) > 0 THEN rs ELSE broken END), ','), '') AS reasons FROM t
""",
    "vector_index_appended": f"WITH {PAIRS_SQL} SELECT q_id, vec_id, sim, CAST(row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) AS INT) AS rank FROM p WHERE sim >= 0.2 QUALIFY rank <= 5",
    "office_documents": r"""
WITH l AS (SELECT doc_id, i, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS r(i)),
d AS (SELECT doc_id, count(*) FILTER (i = 1) AS headings, count(*) FILTER (i > 1) AS paragraphs, CAST(sum(len(regexp_extract_all(line, '\S+'))) AS BIGINT) AS n_words, CAST(sum(length(line) - length(replace(line, '|', ''))) AS BIGINT) AS tables FROM l WHERE line <> '' GROUP BY doc_id)
SELECT *, CASE WHEN n_words > 200 THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS confidence, CASE WHEN n_words < 20 THEN 'too few words' END AS reason FROM d
""",
    "stream_replay_buffer": "SELECT event_id, event_type, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || CAST(event_id AS VARCHAR))) <= 20",
    "hard_negative_pairs": f"WITH {PAIRS_SQL}, n AS (SELECT q_id, vec_id, sim FROM p WHERE sim > 0.3 AND sim < 0.6 AND vec_id <> q_id + 1 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) = 1) SELECT e.vec_id AS anchor, e.vec_id + 1 AS positive, n.vec_id AS negative, sim, CASE WHEN sim IS NULL THEN 'easy' ELSE 'hard' END AS pair_type FROM embeddings e LEFT JOIN n ON n.q_id = e.vec_id WHERE e.vec_id % 50 = 0",
}
