"""A sample of fixed size for each key that batches and streams agree on: the rows whose ids have the smallest hashes.

Of two parts' samples the sample of the whole can be made, so a task passes on at most `size` rows a key, and a stream keeps no more. Every row of a key is
equally likely to be kept, whatever the order in which rows come; reruns agree.

Defined results: rows with a null id take no part; rows equal in key and id count once (the smallest of them); a null key is a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import children

SIZE, RATIO, SEED = 10_000, 0.3, 7


def priority(key: str, seed: int = SEED) -> Column:
    """The smaller, the sooner a row is kept."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample(rows: DataFrame, keys: list[str], key: str, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """At most `size` rows of each of keys. key: the id of a row."""
    once = Window.partitionBy(*keys, "_p").orderBy(F.struct(*rows.columns))
    first = Window.partitionBy(*keys).orderBy("_p")
    # Spark limits the ranks before it shuffles, so a hot key costs its task `size` rows from each of the others
    made = rows.where(F.col(key).isNotNull()).withColumn("_p", priority(key, seed))
    few = made.withColumn("_d", F.dense_rank().over(first)).where(F.col("_d") <= size)
    return few.withColumn("_n", F.row_number().over(once)).where(F.col("_n") == 1).select(*rows.columns)


class ReplayBuffer:
    """The sample of all that has come so far, kept below root, one folder a batch; a repeated batch replaces itself."""

    def __init__(self, root: str, keys: list[str], key: str, size: int = SIZE, ratio: float = RATIO, train: Callable[[DataFrame, int], None] | None = None):
        self.root, self.keys, self.key, self.size, self.ratio, self.train = root, keys, key, size, ratio, train

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The buffer as the newest batch, or the newest before one, left it; None if there is none."""
        found = [int(n[6:]) for n in children(spark, self.root) if n.startswith("batch=")]
        done = [n for n in found if (before is None or n < before) and "_SUCCESS" in children(spark, f"{self.root}/batch={n}")]
        return spark.read.parquet(f"{self.root}/batch={max(done)}") if done else None

    def mixed(self, new: DataFrame, buffer: DataFrame | None, batch: int) -> DataFrame:
        """new with floor(rows * ratio) rows of the buffer, in an order of hashes; replayed tells which are the buffer's."""
        marked = new.withColumn("replayed", F.lit(False))
        if buffer is not None:
            n = int(new.count() * self.ratio)
            marked = marked.unionByName(buffer.orderBy(priority(self.key, batch + 1)).limit(n).withColumn("replayed", F.lit(True)))
        return marked.orderBy(priority(self.key, batch))

    def write(self, new: DataFrame, batch: int) -> None:
        """One batch: train on new rows mixed with old ones, then take the new ones into the buffer."""
        buffer = self.read(new.sparkSession, batch)
        if self.train is not None:
            self.train(self.mixed(new, buffer, batch), batch)
        everything = new if buffer is None else buffer.unionByName(new)
        sample(everything, self.keys, self.key, self.size).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def run(self, stream: DataFrame) -> None:
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.root}/state").foreachBatch(self.write).start()
        query.awaitTermination()
