"""Status updates that a stream merges into a stored table, and the outbox.

The table is Parquet partitioned by ``bucket``, a hash of its key. A batch reads and
replaces only the buckets that its keys are in. It is written twice: first under
``redo/batch=N``, whole, then by dynamic partition overwrite into the table; so a
batch that broke off while buckets were being replaced is finished from its redo
copy when the stream repeats it, and one that is repeated after the end changes
nothing. Counts and rejected rows of a batch are kept under its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.operators.merge import last_write


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def complete(spark: SparkSession, path: str) -> bool:
    """Has a write to the folder been committed?"""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class StatusTable:
    """A table of (key, status, at, and more columns) in ``path``; ``at`` orders the statuses of a key (any type that has an order, a struct too)."""

    def __init__(self, spark: SparkSession, path: str, key: str, status: str, at: str, allowed: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.status, self.at, self.allowed, self.buckets = spark, path.rstrip("/"), key, status, at, allowed, buckets

    def create(self, rows: DataFrame) -> None:
        dealt = rows.withColumn("bucket", bucket_of(self.key, self.buckets)).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def batches(self) -> DataFrame:
        """One row a batch: updated (keys), stale (older than what is stored), invalid (unknown status), missing (unknown key)."""
        return self.spark.read.parquet(f"{self.path}/batches")

    def rejects(self) -> DataFrame:
        """The rejected rows of all batches with their reason."""
        return self.spark.read.parquet(f"{self.path}/rejects")

    def merge(self, batch: DataFrame, number: int) -> None:
        """A ``foreachBatch`` function. Of a key's good updates the newest counts, if it is newer than the stored status."""
        redo = f"{self.path}/redo/batch={number}"
        if not complete(self.spark, f"{self.path}/batches/batch={number}"):
            if not complete(self.spark, redo):
                self._prepare(batch, number, redo)
            if self.spark.read.parquet(f"{redo}/touched").count():
                merged = self.spark.read.parquet(f"{redo}/rows")
                merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
            self.spark.read.parquet(f"{redo}/counts").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batches/batch={number}")
        delete(self.spark, f"{self.path}/redo/batch={number - 1}")

    def _prepare(self, batch: DataFrame, number: int, redo: str) -> None:
        """Everything that the batch will change, computed once from the table as it is."""
        updates = batch.select(self.key, self.status, self.at).withColumn("bucket", bucket_of(self.key, self.buckets)).persist()
        touched = sorted(r["bucket"] for r in updates.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        table = self.rows().where(F.col("bucket").isin(touched))
        known = table.select(self.key, F.col(self.at).alias("stored_at"), "bucket")
        judged = updates.join(known, [self.key, "bucket"], "left").withColumn(
            "reject",
            F.when(~F.coalesce(F.col(self.status).isin(self.allowed), F.lit(False)), "invalid status")
            .when(F.col("stored_at").isNull(), "not found")
            .when(F.col(self.at) <= F.col("stored_at"), "stale"),
        ).persist()
        good = last_write(judged.where("reject is null").select(self.key, "bucket", self.status, self.at), [self.key, "bucket"], [self.at])
        new = good.select(self.key, "bucket", F.struct(F.col(self.status).alias("status"), F.col(self.at).alias("at")).alias("new"))
        changed = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        merged = table.where(F.col("bucket").isin(changed)).join(new, [self.key, "bucket"], "left")
        merged = merged.withColumns({self.status: F.coalesce("new.status", self.status), self.at: F.coalesce("new.at", self.at)}).select(*table.columns)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{redo}/rows")
        judged.where("reject is not null").drop("stored_at", "bucket").write.mode("overwrite").parquet(f"{self.path}/rejects/batch={number}")
        counts = judged.agg(
            F.count_distinct(F.when(F.col("reject").isNull(), F.col(self.key))).alias("updated"),
            *[F.count_if(F.col("reject") == reason).alias(name) for name, reason in (("stale", "stale"), ("invalid", "invalid status"), ("missing", "not found"))],
        )
        counts.write.mode("overwrite").parquet(f"{redo}/counts")
        self.spark.createDataFrame([(b,) for b in changed], "bucket int").write.mode("overwrite").parquet(f"{redo}/touched")
        judged.unpersist()
        updates.unpersist()
        self.spark.createDataFrame([], "done int").write.mode("append").parquet(redo)  # its _SUCCESS marks the whole

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Merge all that the stream has to offer now; a rerun goes on where the last stopped."""
        stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Outbox:
    """Pending rows are claimed (``syncing``), sent, and logged as submitted or failed with a sync record.

    A batch writes the rows that it claims before it sends any, and its outcomes
    after. A batch that broke off between the two left rows in ``syncing``: when it
    is repeated they aren't sent again but logged as ``interrupted``, since some may
    have arrived. So no row is sent by two batches, none is lost from the log, and
    failed ones aren't retried. Spark may run a task of the sending twice; ``attempt``
    is the same then, and the receiver can tell by it.
    """

    def __init__(self, spark: SparkSession, log: str, key: str, created: str, endpoint: str):
        self.spark, self.log, self.key, self.created, self.endpoint = spark, log.rstrip("/"), key, created, endpoint

    def drain(self, send: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function. ``send`` returns the rows it is given with ``succeeded`` (boolean) and ``message``."""

        def run(batch: DataFrame, number: int) -> None:
            claimed, done = f"{self.log}/syncing/batch={number}", f"{self.log}/done/batch={number}"
            if complete(self.spark, done):
                return
            if complete(self.spark, claimed):
                rows = self.spark.read.parquet(claimed)
                out = rows.withColumns({"succeeded": F.lit(None).cast("boolean"), "message": F.lit("interrupted while syncing")})
            else:
                pending = batch.where(F.col("status") == "pending")
                if complete(self.spark, f"{self.log}/any"):
                    pending = pending.join(self.spark.read.parquet(f"{self.log}/syncing").select(self.key), self.key, "left_anti")
                attempt = F.sha2(F.concat_ws(":", F.col(self.key).cast("string"), F.lit(number)), 256)
                # ranges of creation time: the oldest are sent first within a task, and tasks start in order
                pending.withColumn("attempt", attempt).repartitionByRange(self.created, self.key).sortWithinPartitions(self.created, self.key).write.mode("overwrite").parquet(claimed)
                self._begin(batch)
                out = send(self.spark.read.parquet(claimed))
            self._outcomes(out).write.mode("overwrite").parquet(done)

        return run

    def _outcomes(self, sent: DataFrame) -> DataFrame:
        status = F.when(F.col("succeeded"), "submitted").when(~F.col("succeeded"), "failed").otherwise("interrupted")
        record = F.struct(F.current_timestamp().alias("attempted_at"), F.col("succeeded"), F.lit(self.endpoint).alias("endpoint"), F.col("message"))
        return sent.select(self.key, status.alias("status"), record.alias("sync"))

    def _begin(self, batch: DataFrame) -> None:
        """Make the log readable before its first outcome."""
        none = batch.limit(0).withColumns({"succeeded": F.lit(None).cast("boolean"), "message": F.lit("")})
        self._outcomes(none).write.mode("overwrite").parquet(f"{self.log}/done/batch=-1")
        self.spark.createDataFrame([], "begun int").write.mode("overwrite").parquet(f"{self.log}/any")

    def states(self, outbox: DataFrame) -> DataFrame:
        """The rows of ``outbox`` with their status now and their sync records; claimed rows without an outcome are ``syncing``."""
        if not complete(self.spark, f"{self.log}/any"):
            return outbox.withColumn("sync_history", F.array().cast("array<struct<attempted_at:timestamp,succeeded:boolean,endpoint:string,message:string>>"))
        claimed = self.spark.read.parquet(f"{self.log}/syncing").select(self.key).withColumn("claimed", F.lit(True))
        done = self.spark.read.parquet(f"{self.log}/done").drop("batch")
        logged = done.groupBy(self.key).agg(F.max_by("status", "sync.attempted_at").alias("logged"), F.array_sort(F.collect_list("sync")).alias("sync_history"))
        joined = outbox.join(claimed, self.key, "left").join(logged, self.key, "left")
        return joined.withColumn("status", F.coalesce("logged", F.when(F.col("claimed"), "syncing"), "status")).withColumn("sync_history", F.coalesce("sync_history", F.array())).drop("claimed", "logged")
