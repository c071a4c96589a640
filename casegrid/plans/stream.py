"""Streaming queries: events replayed through Structured Streaming, compared with their batch forms."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.plans.registry import Registry
from casegrid.session import table, work_folder
from casegrid.streaming import store
from casegrid.streaming.ingest import ingest
from casegrid.streaming.status_table import Outbox, StatusTable

R = Registry()


@R.add("stream_ingest", """
SELECT event_id, coalesce(seen, false) AS seen, prior_id, CASE WHEN seen THEN 'Graylist' WHEN user_id % 7 = 0 THEN 'OutOfState' WHEN event_type = 'error' THEN 'Flagged' ELSE 'Processed' END AS queue
FROM (SELECT event_id, user_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior_id,
 count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) > 0 AS seen FROM events)""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Stateful ingest by subject; equals the window form on the same rows."""
    work = work_folder(spark, "ingest")
    schema = table(spark, d, "events").schema
    build = lambda s: ingest(s, timedelta(days=2), out_of_state=F.col("user_id") % 7 == 0, flagged=F.col("event_type") == "error")
    got = store.replay_updates(spark, f"{d.rstrip('/')}/events.parquet*", schema, build, f"{work}/out", f"{work}/checkpoint", ["event_id"])
    return got.select("event_id", "seen", "prior_id", "queue")


@R.add("stream_hourly", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over the stream."""
    work = work_folder(spark, "hourly")
    schema = table(spark, d, "events").schema
    build = lambda s: store.windowed_rate(s.select(F.col("ts").cast("timestamp").alias("ts")), "ts", "1 hour")
    got = store.replay_updates(spark, f"{d.rstrip('/')}/events.parquet*", schema, build, f"{work}/out", f"{work}/checkpoint", ["start"])
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@R.add("stream_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")
def stream_status(spark: SparkSession, d: str) -> DataFrame:
    """Newest status by key over the stream."""
    work = work_folder(spark, "status")
    schema = table(spark, d, "events").schema
    build = lambda s: s.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return store.replay_updates(spark, f"{d.rstrip('/')}/events.parquet*", schema, build, f"{work}/out", f"{work}/checkpoint", ["user_id"]).select("user_id", "status")


@R.add("stream_merge", """
SELECT c_custkey, coalesce(status, 'signup') AS status FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1) ON user_id = c_custkey""")
def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    """Status updates, batch by batch and in no order of time, merged into a stored table by key."""
    work = work_folder(spark, "merge")
    start = F.struct(F.lit("1900-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("event_id"))
    kept = StatusTable(spark, f"{work}/table", "key", "status", "at", ["view", "click", "purchase"], buckets=16)
    kept.create(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("signup").alias("status"), start.alias("at")))
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("status"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"))
    events.repartition(3, "at").write.parquet(f"{work}/updates")
    kept.follow(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/updates"), f"{work}/checkpoint")
    return kept.rows().select(F.col("key").alias("c_custkey"), "status")


@R.add("stream_outbox", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'done' WHEN o_orderkey % 10 = 3 THEN 'failed' ELSE 'submitted' END AS status, (o_orderstatus = 'O')::INTEGER AS attempts FROM orders""")
def stream_outbox(spark: SparkSession, d: str) -> DataFrame:
    """The outbox drained once, with sync records."""
    work = work_folder(spark, "outbox")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    box = Outbox(spark, f"{work}/log", "o_orderkey", "o_orderdate", "memory:")
    send = lambda rows: rows.withColumns({"succeeded": F.col("o_orderkey") % 10 != 3, "message": F.lit("sent")})
    box.drain(send)(orders, 0)
    return box.states(orders).select("o_orderkey", "status", F.size("sync_history").alias("attempts"))
