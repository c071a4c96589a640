"""SparkSession factory and table loading shared by every query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "casegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; explicit ``conf`` wins.

    Keyword names use ``__`` for dots: ``spark__ui__enabled="false"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    base.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks_for(rows: DataFrame, each: int | None = None) -> int:
    """Tasks for every core; with ``each``, so many that a task has about that many rows at any size."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return max(tasks, rows.count() // each) if each else tasks


def spread(rows: DataFrame, key: str, each: int | None = None) -> DataFrame:
    """Rows of few bytes and much work, by ``key`` over more tasks than their files have parts, or over ``tasks_for`` rows of ``each``."""
    return rows.repartition(tasks_for(rows, each), key)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see; a local one only where no checkpoint folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='casegrid-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"
