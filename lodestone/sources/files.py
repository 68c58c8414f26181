"""Files in, files out: JSON lines, loose JSON, folders as manifests, datasets by key, numbered snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import children

PAIR = "pair_id string, anchor string, positive string, negative string, subject string, bloom_level string, source string, confidence double"
#: The folders of a subject and the file types that a manifest lists.
CATEGORIES = ("textbooks", "notes", "previous_papers")
SUFFIXES = ("pdf", "docx", "pptx", "txt", "md", "json")
MIN_CONTENT = 40


def read_pairs(spark: SparkSession, path: str, subject: str | None = None, max_samples: int | None = None, schema: str | StructType = PAIR) -> DataFrame:
    """Training pairs from JSON lines; blank lines and lines without an anchor go. max_samples is a limit of the caller's choice."""
    rows = spark.read.schema(schema).json(path).where("anchor is not null")
    rows = rows if subject is None else rows.where(F.col("subject") == subject)
    return rows if max_samples is None else rows.limit(max_samples)


def read_loose_json(spark: SparkSession, path: str, min_content: int = MIN_CONTENT) -> DataFrame:
    """file, item (map of strings): objects of JSON files whose content is over min_content characters.

    Control characters are taken out first; a file is one object or a list of them; files that don't parse give nothing.
    """
    text = F.trim(F.regexp_replace("value", r"[\x00-\x1f\x7f-\x9f]", " "))
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    items = F.from_json(listed, "array<map<string,string>>")
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(items).alias("item"))
    return rows.where(F.length(F.try_element_at("item", F.lit("content"))) > min_content)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """subject, category, path, hash of the files in root/subject/category/..., by the MD5 of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = rf"/([^/]+)/({'|'.join(CATEGORIES)})/.*\.(?i:{'|'.join(SUFFIXES)})$"
    rows = files.select(F.regexp_extract("path", part, 1).alias("subject"), F.regexp_extract("path", part, 2).alias("category"), "path", F.md5("content").alias("hash"))
    return rows.where("category <> ''")


def not_cached(files: DataFrame, cache: DataFrame, digest: str = "hash") -> DataFrame:
    """Files whose content the cache doesn't hold yet."""
    return files.join(cache.select(digest).distinct(), digest, "left_anti")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, nulls written out, text as it is."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_by_key(df: DataFrame, path: str, key: Column, default: str = "GENERIC", name: str = "key") -> None:
    """JSON lines in one folder a key; rows without a key go to the default."""
    named = df.withColumn(name, F.when(F.trim(key) != "", key).otherwise(F.lit(default)))
    named.write.partitionBy(name).option("ignoreNullFields", "false").json(path)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished snapshots below root, ascending."""
    found = [int(n[9:]) for n in children(spark, root) if n.startswith("version=v") and n[9:].isdigit()]
    return sorted(v for v in found if "_SUCCESS" in children(spark, f"{root}/version=v{v}"))


def create_version(df: DataFrame, root: str) -> int:
    """Write df as the next snapshot. One that was cut off has no _SUCCESS mark: it isn't listed and is written over."""
    number = max(versions(df.sparkSession, root), default=0) + 1
    df.write.mode("overwrite").parquet(f"{root}/version=v{number}")
    return number


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """A snapshot, the latest unless told otherwise."""
    found = versions(spark, root)
    if not found:
        raise ValueError(f"no snapshot in {root}")
    return spark.read.parquet(f"{root}/version=v{found[-1] if number is None else number}")
