"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. Only a local session may leave that unset: its tasks share one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"lodestone-{os.getuid()}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark then deletes the shuffle files of a query when it ends, not when the driver comes to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the plan is cut, its shuffle files go, and what follows survives lost executors."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._lodestone_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        spark, path = df.sparkSession, df._lodestone_path
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark can reach; none where the folder is missing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
