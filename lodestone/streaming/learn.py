"""Learning from files as they come: what changed is parsed, merged into a store, and training starts when enough is new.

Every batch of the stream writes one folder a table, named by the batch, and decides from folders of earlier batches alone. So a batch that
is repeated, after it was cut off anywhere between its tables, writes the same again over what it had left.

Tables below root: manifest (path, hash of each file as it changed), objects (what files gave, each object_id once, the first wins), trained (a row for each
training that was started, with the objects that were new to it).

Defined results: of a path that comes several times in a batch the newest row counts; a file whose hash is the known one is skipped; rows with a null path or hash
take no part; objects with a null object_id go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import children


class Learner:
    """parse: changed files to objects (object_id and whatever else). train(objects, version): called when `enough` objects are new and not frozen()."""

    def __init__(self, root: str, parse: Callable[[DataFrame], DataFrame], enough: int, train: Callable[[DataFrame, int], None] | None = None, frozen: Callable[[], bool] = lambda: False):
        self.root, self.parse, self.enough, self.train, self.frozen = root, parse, enough, train, frozen

    def table(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame | None:
        """The rows of a table, or those of batches before one; None if there are none."""
        found = [n for n in children(spark, f"{self.root}/{name}") if n.startswith("batch=")]
        done = [n for n in found if (before is None or int(n[6:]) < before) and "_SUCCESS" in children(spark, f"{self.root}/{name}/{n}")]
        if not done:
            return None
        return spark.read.option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/{n}" for n in done])

    def _put(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.root}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def write(self, files: DataFrame, batch: int) -> None:
        """One batch. files: path, hash, modified and what parse needs."""
        spark = files.sparkSession
        newest = files.where("path is not null and hash is not null").groupBy("path").agg(F.max_by(F.struct(*files.columns), F.struct("modified", "hash")).alias("r")).select("r.*")
        known = self.table(spark, "manifest", batch)
        if known is not None:
            last = known.groupBy("path").agg(F.max_by("hash", "batch").alias("_known"))
            newest = newest.join(last, "path", "left").where("_known is null or _known <> hash").drop("_known")
        changed = self._put(newest, "manifest", batch)
        objects = self.parse(changed).where("object_id is not null").dropDuplicates(["object_id"])
        store = self.table(spark, "objects", batch)
        if store is not None:
            objects = objects.join(store.select("object_id"), "object_id", "left_anti")
        self._put(objects, "objects", batch)
        self._check(spark, batch)

    def _check(self, spark: SparkSession, batch: int) -> None:
        trained = self.table(spark, "trained", batch)
        since = -1 if trained is None else trained.agg(F.max("upto")).first()[0]
        store = self.table(spark, "objects", batch + 1)
        new = 0 if store is None else store.where(F.col("batch") > since).count()
        if new < self.enough or self.frozen():
            return
        version = 1 if trained is None else trained.count() + 1
        if self.train is not None:
            self.train(store, version)
        self._put(spark.createDataFrame([(version, batch, new)], "version int, upto int, n_new long").coalesce(1), "trained", batch)

    def run(self, stream: DataFrame) -> None:
        """Over all files there are; the next call goes on where this one stopped."""
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.root}/state").foreachBatch(self.write).start()
        query.awaitTermination()
