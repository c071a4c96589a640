"""Streaming forms of the case store: windowed rates, newest status, replay of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_rate(stream: DataFrame, at: str, width: str = "1 second", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per window, late rows accepted up to ``late``."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width, slide or width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def status_stream(updates: DataFrame, late: str = "1 day") -> DataFrame:
    """Newest status of each key so far (update mode)."""
    return updates.withWatermark("at", late).groupBy("case_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def replay(spark: SparkSession, path: str, schema, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over the files that are there, then read what it wrote. Files are the log, so a rerun goes on where it stopped."""
    stream = build(spark.readStream.schema(schema).parquet(path))
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def replay_updates(spark: SparkSession, path: str, schema, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: list[str], max_files: int | None = None) -> DataFrame:
    """The same for a stream that updates rows by ``key``: every batch's changed rows go to a folder of its number, and the newest row of a key counts. ``max_files``: files a batch takes at most."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    reader = spark.readStream.schema(schema)
    stream = build((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    log = spark.read.parquet(out)
    rest = [c for c in log.columns if c not in (*key, "batch")]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*key, "row.*")
