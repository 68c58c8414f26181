"""Word and slide files as rows of blocks. Files are read by Spark wherever it can reach them; a task unpacks one file at a time.

Blocks of a .docx are its paragraphs (kind heading where the style says so, else text), then its tables; those of a .pptx go slide by slide, its shapes (text)
and its tables, in their order. A table's cells are joined by ` | `, its rows by line feeds.

Defined results: empty paragraphs, shapes and rows give no block; a file that can't be read gives one row of kind error with the reason as its text; a
null content is such a file; other suffixes are left out, and Spark itself leaves out files without any byte.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "path string, page int, seq int, kind string, text string"
_W, _A, _P = ("{http://schemas.openxmlformats.org/%s/main}" % x for x in ("wordprocessingml/2006", "drawingml/2006", "presentationml/2006"))  # noqa: UP031
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Words that a document must have, and the confidences of its kinds.
MIN_WORDS, MANY_WORDS = 20, 200


def _paragraph(p: ElementTree.Element, ns: str) -> str:
    parts = {f"{ns}t": lambda e: e.text or "", f"{ns}tab": lambda e: "\t", f"{ns}br": lambda e: "\n"}
    return "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)


def _table(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows if any(r))


def docx_blocks(data: bytes) -> list[tuple[int, str, str]]:
    """(page, kind, text): page is 0, as a .docx has none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    blocks, tables = [], []
    for e in () if body is None else body:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            heading = style is not None and style.get(f"{_W}val", "").startswith("Heading")
            blocks.append((0, "heading" if heading else "text", _paragraph(e, _W).strip()))
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(_paragraph(p, _W) for p in c.iter(f"{_W}p")).strip() for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            tables.append((0, "table", _table(rows)))
    return [b for b in blocks + tables if b[2]]


def pptx_blocks(data: bytes) -> list[tuple[int, str, str]]:
    """(slide, kind, text), slides from 1 on in the order of the presentation."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if "ppt/_rels/presentation.xml.rels" in names:
            target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
            order = [target[s.get(f"{_R}id")].lstrip("/") for s in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")]
            slides = [t if t.startswith("ppt/") else f"ppt/{t}" for t in order]
        else:
            slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        made = []
        for page, name in enumerate(slides, 1):
            for shape in ElementTree.fromstring(z.read(name)).iter():
                if shape.tag == f"{_P}sp":
                    made.append((page, "text", "\n".join(_paragraph(p, _A) for p in shape.iter(f"{_A}p")).strip()))
                elif shape.tag == f"{_A}tbl":
                    rows = [[x for x in ("\n".join(_paragraph(p, _A) for p in c.iter(f"{_A}p")).strip() for c in r.iter(f"{_A}tc")) if x] for r in shape.iter(f"{_A}tr")]
                    made.append((page, "table", _table(rows)))
    return [b for b in made if b[2]]


_READERS = {"docx": docx_blocks, "pptx": pptx_blocks}


def blocks(files: DataFrame) -> DataFrame:
    """path, page, seq, kind, text of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    found = _READERS[path.rpartition(".")[2].lower()](content.as_py() or b"")
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, OSError, EOFError, NotImplementedError, RuntimeError) as e:
                    found = [(0, "error", f"{type(e).__name__}: {e}")]
                if found:
                    page, kind, text = zip(*found, strict=True)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(page, pa.int32()), pa.array(range(n), pa.int32()), pa.array(kind), pa.array(text)], names=["path", "page", "seq", "kind", "text"])

    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*_READERS)
    return files.where(known).select("path", "content").mapInArrow(run, BLOCK)


def read_blocks(spark: SparkSession, root: str) -> DataFrame:
    """The blocks of all .docx and .pptx files below root."""
    return blocks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))


def documents(made: DataFrame) -> DataFrame:
    """path, text, n_words, tables, confidence, reason: a row a file, from its blocks.

    reason: `too few words` below MIN_WORDS (a .docx) or without any (a .pptx), or what kept the file from being read; null where it is fine.
    """
    order = F.sort_array(F.collect_list(F.struct("seq", "text")))  # a file's own blocks
    each = made.groupBy("path").agg(F.array_join(F.transform(order, lambda x: x["text"]), "\n\n").alias("text"), F.max(F.when(F.col("kind") == "error", F.col("text"))).alias("error"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    docx = F.lower("path").endswith(".docx")
    named = each.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise("")).withColumn("n_words", words.cast("long"))
    few = F.col("n_words") < F.when(docx, MIN_WORDS).otherwise(1)
    return named.select(
        "path", "text", "n_words", F.when(docx, F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).otherwise(0).cast("long").alias("tables"),
        F.when(~docx, 0.75).when(F.col("n_words") > MANY_WORDS, 0.85).otherwise(0.60).alias("confidence"), F.coalesce("error", F.when(few, "too few words")).alias("reason"),
    )
