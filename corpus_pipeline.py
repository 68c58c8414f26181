"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage reads all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import lines, mixing, nearcopies, packing, quality
from lodestone.llm.common import shared_dir

#: Near copies are told by shingles of five words.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality.judge(docs, keep_rows=True)
    # as a filter the verdict would be pushed below the steps it rests on, and they would be evaluated again and again
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of lines go; a document that loses every line goes; n_chars follows the text."""
    made = lines.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    row = F.col("_row").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")))
    return made.select(row.alias("_row")).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays: the one with the smallest doc_id."""
    return nearcopies.keep_one(docs, width=SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: Fingerprints and token ids can't be expressed in SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
