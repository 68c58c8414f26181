"""Structured Streaming over event files: windows, keyed state, tails, folders that are watched.

Aggregations run in update mode: state older than the watermark is dropped, and each batch writes the keys it
changed to its own folder, over what a failed attempt left there. The newest row of each key is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import work_path


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream with the schema they have now; files that come later are read in later batches."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a stream reads folders or patterns, so a single file is named by a pattern that only it matches
    return reader.parquet(path[:-1] + f"[{path[-1]}]" if path.endswith(".parquet") else path)


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds at: the wall-clock time of ts as an instant in UTC, whatever the session's time zone."""
    seconds = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))"
    return events.withColumn("at", F.timestamp_micros(F.expr(seconds)))


def drain(stream: DataFrame, keys: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Run a stream over all there is and return its rows; with keys, the newest row of each.

    With a path given, the next call goes on where this one stopped.
    """
    spark = stream.sparkSession
    path = path or work_path(spark, "stream")
    out = BatchRows(path)
    query = stream.writeStream.outputMode("update" if keys else "append").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(out.write).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/rows")
    if not keys:
        return rows.drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_r")).select("_r.*")


class BatchRows:
    """Writes each batch to its own folder, so that a batch that is repeated replaces itself."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")


def windowed(events: DataFrame, size: str, slide: str | None = None, by: list[str] | None = None, late: str = "1 day") -> DataFrame:
    """start (seconds), the columns in by, n and total of each event-time window; events later than `late` are dropped."""
    made = event_time(events).withWatermark("at", late).groupBy(F.window("at", size, slide).alias("w"), *(by or []))
    return made.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_timestamp(F.col("w.start")).alias("start"), *(by or []), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """user_id, start, end (seconds), n of sessions that the watermark has closed."""
    made = event_time(events).withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.unix_timestamp(F.col("w.start")).alias("start"), F.unix_timestamp(F.col("w.end")).alias("end"), "n")


def once(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return event_time(events).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def stages(events: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """user_id, stage: the furthest stage a key has reached. A maximum is all the state a key needs."""
    rank = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ranks.items()], F.lit(0))
    return events.groupBy("user_id").agg(F.max(rank).alias("stage"))


def watch_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, hash of files as they come or change."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.md5("content").alias("hash"))
