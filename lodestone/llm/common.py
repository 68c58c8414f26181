"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of ASCII white space; everything between two runs is a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_ASCII = str.maketrans(UPPER, LOWER)
#: A null doc_id is ordered after every other.
LAST_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave that unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"lodestone-{os.getuid()}")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage is cut and what follows survives lost executors.

    files: at most so many tasks make and write it, for a table too small for a task and a file of each shuffle partition.
    """
    df = df.coalesce(files) if files else df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._lodestone_path = path
    return made


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a staged table that nothing will read again. Its place is the path that the plan reads, so no file is listed."""
    path = df._lodestone_path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST_ID))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns under their own names, and the row's key: _id (null last) and _th, a hash of the text.

    Rows equal in doc_id and text are one document met twice: they share the key and so every result.
    """
    cols = [F.col(c) for c in dict.fromkeys(("doc_id", "text", *columns))]
    return docs.select(*cols, order_id(F.col("doc_id")).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_th"))
