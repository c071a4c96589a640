"""Queries on traces and their chat turns, over events as steps of a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.operators import conversations
from casegrid.plans.registry import Registry
from casegrid.session import spread, table, tasks_for

R = Registry()

#: steps of traces that a task puts in order
STEPS_A_TASK = 100_000


def _traces(spark: SparkSession, d: str) -> DataFrame:
    """user_id, trace: views and signups are messages with up to two calls, clicks and purchases are results, errors plain messages."""
    e = spread(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", STEPS_A_TASK)
    calls = F.when(F.col("event_type").isin("view", "signup") & (F.col("event_id") % 3 > 0), F.transform(F.sequence(F.lit(1), (F.col("event_id") % 3).cast("int")), lambda k: F.struct(F.concat(F.lit("c"), F.col("event_id").cast("string"), F.lit("_"), (k - 1).cast("string")).alias("id"), F.struct(F.lit("lookup").alias("name"), F.lit("{}").alias("arguments")).alias("function"))))
    told = F.when(F.col("event_type").isin("click", "purchase"), "lookup")
    step = F.struct(F.col("event_type").alias("content"), told.alias("tool_result"), F.struct(F.col("value")).alias("result"), calls.alias("tool_calls"))
    listed = F.array_sort(F.collect_list(F.struct("ts", "event_id", step.alias("step"))))
    return e.groupBy("user_id").agg(F.to_json(F.transform(listed, lambda x: x["step"])).alias("trace"))


@R.add("k16_trace_turns", """
WITH RECURSIVE e AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS pos, event_id, event_type IN ('click', 'purchase') AS told,
  CASE WHEN event_type IN ('view', 'signup') THEN (event_id % 3)::INTEGER ELSE 0 END AS n FROM events),
q(user_id, pos, waiting, answered, made, alone) AS (
  SELECT DISTINCT user_id, -1, 0, 0, 0, false FROM events
  UNION ALL
  SELECT e.user_id, e.pos, CASE WHEN e.told AND q.waiting > 0 THEN q.waiting - 1 ELSE q.waiting + e.n END, q.answered + (e.told AND q.waiting > 0)::INTEGER, q.made + (e.told AND q.waiting = 0)::INTEGER, e.told AND q.waiting = 0
  FROM q JOIN e ON e.user_id = q.user_id AND e.pos = q.pos + 1),
calls AS (SELECT user_id, pos, k, 'c' || event_id || '_' || k AS id, row_number() OVER (PARTITION BY user_id ORDER BY pos, k) AS nth FROM (SELECT *, unnest(range(n)) AS k FROM e WHERE n > 0))
SELECT user_id, pos, 0 AS part, 'assistant' AS role, id AS call_id FROM calls WHERE k = 0
UNION ALL SELECT user_id, pos, 0, 'assistant', 'synthetic_tool_call_' || (made - 1) FROM q WHERE alone
UNION ALL SELECT q.user_id, q.pos, 1, 'tool', CASE WHEN q.alone THEN 'synthetic_tool_call_' || (q.made - 1) ELSE c.id END
FROM q JOIN e USING (user_id, pos) LEFT JOIN calls c ON c.user_id = q.user_id AND c.nth = q.answered WHERE e.told""")
def k16(spark: SparkSession, d: str) -> DataFrame:
    """Results paired with calls first in, first out; calls made up where none waits."""
    tasks = tasks_for(table(spark, d, "events"), STEPS_A_TASK)
    return conversations.trace_turns(_traces(spark, d), "user_id", "trace", tasks).select("user_id", "pos", "part", "role", "call_id")


@R.add("k17_missing_lookups", """
WITH c AS (SELECT l_orderkey AS case_id, p_brand AS code, l_linenumber AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT case_id, code, min(n) AS place FROM c GROUP BY 1, 2), have AS (SELECT DISTINCT case_id, code FROM c WHERE n % 2 = 0),
names AS (SELECT p_brand AS code, min(p_name) AS query FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1),
m AS (SELECT t.case_id, t.code, t.place, query FROM t LEFT JOIN names USING (code) WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.case_id = t.case_id AND h.code = t.code))
SELECT case_id, code, query, (CASE WHEN query IS NOT NULL THEN row_number() OVER (PARTITION BY case_id, (query IS NOT NULL) ORDER BY place, code) - 1 END)::INTEGER AS nth FROM m""")
def k17(spark: SparkSession, d: str) -> DataFrame:
    """Codes that the first extraction lacks, numbered in order where they have a name to look up."""
    brands = table(spark, d, "part").select("p_partkey", "p_brand")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(brands, F.col("l_partkey") == F.col("p_partkey"))
    pair = F.struct(F.col("l_linenumber").alias("n"), F.col("p_brand").alias("code"))
    codes = lambda c: F.array_distinct(F.transform(F.array_sort(c), lambda x: x["code"]))
    cases = lines.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_list(pair).alias("t"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, pair)).alias("h"))
    none = F.array().cast("array<string>")
    axes = lambda c: F.struct(codes(c).alias("conditions"), none.alias("loincs"), none.alias("rxnorms"))
    names = table(spark, d, "part").where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("code")).agg(F.min("p_name").alias("query"))
    names = names.select(F.lit("conditions").alias("axis"), "code", "query", F.lit("[]").alias("result"))
    found = conversations.missing_codes(cases.select("case_id", axes(F.col("t")).alias("target"), axes(F.col("h")).alias("candidate")), "case_id", names)
    return found.select("case_id", "code", "query", "nth")


@R.add("o8_grounded", """
WITH c AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0) AS g, list(DISTINCT event_type) FILTER (WHERE value > 50) AS m FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(CASE WHEN len(coalesce(g, [])) > 0 THEN g ELSE coalesce(m, []) END), ',') AS codes FROM c""")
def o8(spark: SparkSession, d: str) -> DataFrame:
    """Codes grounded by tools with those of the model's that are among them; the model's where nothing is grounded."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("g"), F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("m"))
    return e.select("user_id", F.array_join(F.array_sort(conversations.grounded_union(F.col("g"), F.col("m"))), ",").alias("codes"))
