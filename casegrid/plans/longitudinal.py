"""Longitudinal queries over events: prior rows, duplicates, diffs, windows, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegrid.operators import scores, segments, visits
from casegrid.plans.registry import Registry
from casegrid.session import table

R = Registry()


@R.add("j8_prior_case", """
SELECT event_id, lag(event_id) OVER w AS prior_id, lag(event_type) OVER w AS prior_type, date_diff('day', lag(ts) OVER w, ts)::INTEGER AS days
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    """The newest earlier case of the same subject and the days between."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    e = segments.with_prior(e, "user_id", "ts", "event_id", {"prior_id": "event_id", "prior_type": "event_type", "prior_ts": "ts"})
    return e.select("event_id", "prior_id", "prior_type", F.datediff("ts", "prior_ts").alias("days"))


@R.add("j9_prior_range", """
SELECT e.event_id, count(p.event_id)::BIGINT AS n_prior, round(coalesce(sum(p.value), 0), 4) AS prior_value
FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.ts < e.ts GROUP BY e.event_id""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    """All cases strictly before, summed by a range frame instead of a self-join."""
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    e = segments.running(e, "user_id", "at", None, {"n_prior": ("count", "*"), "before": ("sum", "value")})
    return e.select("event_id", "n_prior", F.round(F.coalesce("before", F.lit(0.0)), 4).alias("prior_value"))


@R.add("j10_graylist", """
SELECT event_id, seen, CASE WHEN seen THEN 'Graylist' WHEN user_id % 7 = 0 THEN 'OutOfState' WHEN event_type = 'error' THEN 'Flagged' ELSE 'Processed' END AS queue
FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) > 0 AS seen FROM events)""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Repeats inside the window are flagged, then the queue state by precedence."""
    e = table(spark, d, "events")
    seen = visits.seen_before(e, ["user_id", "event_type"], "ts", "interval '2 00:00:00.000000' day to second", "interval '0 00:00:00.000001' day to second")
    e = e.withColumn("seen", seen)
    queue = F.when(F.col("seen"), "Graylist").when(F.col("user_id") % 7 == 0, "OutOfState").when(F.col("event_type") == "error", "Flagged").otherwise("Processed")
    return e.select("event_id", "seen", queue.alias("queue"))


def _visit_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    day = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("codes"))
    return day.withColumn("prior", F.lag("codes").over(Window.partitionBy("user_id").orderBy("day")))


_DAYS = """WITH v AS (SELECT user_id, ts::DATE AS day, list_sort(list(DISTINCT event_type)) AS codes FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(codes) OVER (PARTITION BY user_id ORDER BY day) AS prior FROM v)"""


@R.add("o1_visit_diff", _DAYS + """
SELECT user_id, day, array_to_string(list_sort(list_filter(codes, lambda x: NOT list_contains(coalesce(prior, codes), x))), ',') AS added,
       array_to_string(list_sort(list_filter(coalesce(prior, codes), lambda x: NOT list_contains(codes, x))), ',') AS removed,
       array_to_string(list_sort(list_filter(codes, lambda x: list_contains(coalesce(prior, codes), x))), ',') AS unchanged FROM p""")
def o1(spark: SparkSession, d: str) -> DataFrame:
    """Added, removed and unchanged codes of each visit."""
    v = _visit_rows(spark, d)
    return v.select("user_id", "day", *[F.array_join(c, ",").alias(k) for k, c in visits.set_changes(F.col("codes"), F.col("prior")).items()])


@R.add("o3_flat_diff", _DAYS + """
SELECT user_id, day, code, change_type FROM (
  SELECT user_id, day, unnest(codes) AS code, 'x' AS k, coalesce(prior, codes) AS b, codes FROM p) t,
  LATERAL (SELECT CASE WHEN list_contains(b, code) THEN 'unchanged' ELSE 'added' END AS change_type)
UNION ALL
SELECT user_id, day, code, 'removed' FROM (SELECT user_id, day, unnest(prior) AS code, codes FROM p WHERE prior IS NOT NULL) WHERE NOT list_contains(codes, code)""")
def o3(spark: SparkSession, d: str) -> DataFrame:
    """One row a change; first visits are unchanged."""
    return visits.flat_changes(_visit_rows(spark, d), "user_id", "day", "codes", "prior")


@R.add("o4_display_changes", """
WITH e AS (SELECT user_id, ts::DATE AS day, event_type AS code, min(props) AS display, CASE WHEN event_type = 'error' THEN 'lab' ELSE 'condition' END AS axis FROM events GROUP BY 1, 2, 3),
v AS (SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM (SELECT DISTINCT user_id, day FROM e))
SELECT v.user_id, v.day, e.axis, 'urn:type' AS code_system, e.code, e.display, CASE WHEN v.before IS NULL OR p.code IS NOT NULL THEN 'unchanged' ELSE 'added' END AS change_type
FROM v JOIN e ON e.user_id = v.user_id AND e.day = v.day LEFT JOIN e p ON p.user_id = v.user_id AND p.day = v.before AND p.code = e.code
UNION ALL SELECT v.user_id, v.day, p.axis, 'urn:type', p.code, p.display, 'removed' FROM v JOIN e p ON p.user_id = v.user_id AND p.day = v.before LEFT JOIN e ON e.user_id = v.user_id AND e.day = v.day AND e.code = p.code WHERE e.code IS NULL""")
def o4(spark: SparkSession, d: str) -> DataFrame:
    """Changes with axis, system and display; removed codes keep the prior visit's display."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("code")).agg(F.min("props").alias("display"))
    entity = F.struct(F.when(F.col("code") == "error", "lab").otherwise("condition").alias("axis"), F.lit("urn:type").alias("code_system"), "code", "display")
    seen = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(entity)).alias("entities"))  # a day has few codes
    seen = seen.withColumn("prior", F.lag("entities").over(Window.partitionBy("user_id").orderBy("day")))
    return visits.entity_changes(seen, "user_id", "day", "entities", "prior")


@R.add("w5_running_peak", """
SELECT event_id, round(max(value) OVER w, 2) AS peak, round(sum(value) OVER w, 2) AS running_sum, (count(*) OVER w)::BIGINT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def w5(spark: SparkSession, d: str) -> DataFrame:
    """Running maximum, sum and count (the mean is their ratio)."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    e = segments.running(e, "user_id", "ts", "event_id", {"peak": ("max", "value"), "running_sum": ("sum", "value"), "n": ("count", "*")})
    return e.select("event_id", F.round("peak", 2).alias("peak"), F.round("running_sum", 2).alias("running_sum"), "n")


@R.add("w6_trailing_rate", """
SELECT event_id, round(n / greatest(0.05, span), 6) AS rate FROM (
  SELECT event_id, count(*) OVER w AS n, (epoch_us(ts) - epoch_us(min(ts) OVER w)) / 1e6 AS span FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW))""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    """Rate in a trailing time window, with a floor of the span."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    e = segments.trailing_time(e, "user_id", "at", 3_600_000_000, {"n": F.count("*"), "first": F.min("at")})
    span = (F.col("at") - F.col("first")) / F.lit(1e6)
    return e.select("event_id", F.round(F.col("n") / F.greatest(F.lit(0.05), span), 6).alias("rate"))


@R.add("w7_last60", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING), 2) AS sum60, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 59 PRECEDING)::BIGINT AS n FROM events")
def w7(spark: SparkSession, d: str) -> DataFrame:
    """The last sixty values."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    e = segments.trailing_rows(e, "user_id", "ts", "event_id", 60, {"s": F.sum("value"), "n": F.count("*")})
    return e.select("event_id", F.round("s", 2).alias("sum60"), "n")


@R.add("a17_majority_vote", """
WITH v AS (SELECT user_id, ts::DATE AS run, event_type FROM events), r AS (SELECT user_id, count(DISTINCT run) AS runs FROM v GROUP BY 1)
SELECT v.user_id, v.event_type, count(*)::BIGINT AS votes, r.runs::BIGINT AS runs FROM v JOIN r ON r.user_id = v.user_id GROUP BY ALL HAVING count(*) >= floor(r.runs / 2) + 1""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    """Codes that a majority of runs hold, every occurrence counted."""
    v = table(spark, d, "events").select("user_id", F.to_date("ts").alias("run"), "event_type")
    return scores.majority(v, "user_id", "run", ["event_type"]).select("user_id", "event_type", "votes", "runs")


@R.add("j15_flips", "SELECT user_id, event_type, count(DISTINCT floor(value / 20))::BIGINT AS outcomes, count(*)::BIGINT AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT floor(value / 20)) > 1")
def j15(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose outcome differs between runs."""
    e = table(spark, d, "events").where("value is not null")
    return e.groupBy("user_id", "event_type").agg(F.countDistinct(F.floor(F.col("value") / 20)).alias("outcomes"), F.count("*").alias("n")).where("outcomes > 1")


@R.add("p21_history", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS visit FROM events WHERE user_id IS NOT NULL")
def p21(spark: SparkSession, d: str) -> DataFrame:
    """A subject's history, oldest first; no subject, no history."""
    e = table(spark, d, "events").where("user_id is not null").select("user_id", "event_id", "ts")
    e = segments.running(e, "user_id", "ts", "event_id", {"visit": ("count", "*")})
    return e.select("user_id", "event_id", F.col("visit").cast("int").alias("visit"))


@R.add("a20_trace_rollup", """
SELECT user_id, count(*)::BIGINT AS turns, round(sum(value), 4) AS elapsed, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS tokens,
       round(CASE WHEN sum(value) > 0 THEN sum(CAST(json_extract(props, '$.k') AS BIGINT)) / sum(value) END, 4) AS rate, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors
FROM events GROUP BY 1""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    """Roll-up of a trace: elapsed, tokens, rate, errors."""
    e = table(spark, d, "events").select("user_id", "value", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    out = e.groupBy("user_id").agg(F.count("*").alias("turns"), F.sum("value").alias("s"), F.sum("k").alias("tokens"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select("user_id", "turns", F.round("s", 4).alias("elapsed"), "tokens", F.round(F.when(F.col("s") > 0, F.col("tokens") / F.col("s")), 4).alias("rate"), "errors")


@R.add("j20_first_result", """
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_purchase FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    """The first result of a kind in each trace."""
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_purchase"))
