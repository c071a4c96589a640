"""Filters, joins, aggregates, sorts and table maintenance (SURVEY ids P, J, A, K) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegrid.operators import merge, pareto, ranks, routing
from casegrid.plans.registry import Registry
from casegrid.session import table

R = Registry()


@R.add("a3_event_percentiles", """
SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS mean_value,
       round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 4) AS share_over_50,
       round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95
FROM events GROUP BY event_type""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    """A1-A3: count, mean, success rate, exact interpolated percentiles."""
    e = table(spark, d, "events")
    means = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.avg((F.col("value") > 50).cast("double")), 4).alias("share_over_50"))
    middle = ranks.interpolated(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return means.join(middle, "event_type").select("event_type", "n", "mean_value", "share_over_50", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@R.add("a8_status_counts", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def a8(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status, largest first."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@R.add("a9_top_recent", """
SELECT user_id, count(*)::BIGINT AS n FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent in the last seven days before the newest row."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("as_of"))
    recent = e.join(F.broadcast(now)).where(F.col("ts") > F.col("as_of") - F.expr("interval 7 days"))
    return recent.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@R.add("a2_success_rate", """
SELECT d.lang, count(*)::BIGINT AS n, round(avg(CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END), 4) AS rate
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang""")
def a2(spark: SparkSession, d: str) -> DataFrame:
    """A2: success rate by a joined dimension."""
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == 1).cast("double")), 4).alias("rate"))


@R.add("j1_runs_by_dim", """
SELECT o.o_orderpriority, count(*)::BIGINT AS lines, round(avg(l.l_quantity), 4) AS avg_quantity, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'F' GROUP BY o.o_orderpriority""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    """Runs joined with their experiment, filtered and grouped."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    return lines.join(o, lines.l_orderkey == o.o_orderkey).groupBy("o_orderpriority").agg(
        F.count("*").alias("lines"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
    )


@R.add("a10_group4_nulls_last", """
SELECT r_name, n_name, c_mktsegment, o_orderstatus, count(*)::BIGINT AS n, round(sum(CASE WHEN o_totalprice > 150000 THEN o_totalprice END), 2) AS sum_large, count(CASE WHEN o_totalprice > 150000 THEN 1 END)::BIGINT AS n_large
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ALL ORDER BY sum_large DESC NULLS LAST, r_name, n_name, c_mktsegment, o_orderstatus""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    """A10: four keys, sum and count of the large (their ratio is the mean), nulls last; the two dimensions are fixed in size."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    out = joined.groupBy("r_name", "n_name", "c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("case when o_totalprice > 150000 then o_totalprice end")), 2).alias("sum_large"), F.count_if(F.col("o_totalprice") > 150000).alias("n_large"))
    return out.orderBy(F.desc_nulls_last("sum_large"), "r_name", "n_name", "c_mktsegment", "o_orderstatus")


@R.add("a19_duplicates", "SELECT o_custkey, o_orderdate, count(*)::BIGINT AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur more than once."""
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n")).where("n > 1")


@R.add("a21_suite_rollup", """
WITH s AS (SELECT o_orderpriority AS suite, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS ok, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT suite, n::BIGINT AS n, ok::BIGINT AS ok, round(ok / n, 4) AS rate FROM s
UNION ALL SELECT 'all', sum(n)::BIGINT, sum(ok)::BIGINT, round(sum(ok) / sum(n), 4) FROM s""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    """By suite, then over all suites, from one pass."""
    o = table(spark, d, "orders")
    out = o.rollup("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))
    return out.select(F.coalesce("o_orderpriority", F.lit("all")).alias("suite"), "n", "ok", F.round(F.col("ok") / F.col("n"), 4).alias("rate"))


@R.add("a22_profile", """
SELECT o_orderpriority, count(*)::BIGINT AS n, round(min(o_totalprice), 2) AS least, round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 2) AS median, round(max(o_totalprice), 2) AS most
FROM orders WHERE o_totalprice > 0 GROUP BY 1""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    """Profile of the positive values."""
    o = table(spark, d, "orders").where("o_totalprice > 0")
    sums = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("least"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.max("o_totalprice"), 2).alias("most"))
    middle = ranks.interpolated(o, ["o_orderpriority"], "o_totalprice", {"median": 0.5}).withColumn("median", F.round("median", 2))
    return sums.join(middle, "o_orderpriority")


@R.add("a23_distinct_sorted", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values in order."""
    return table(spark, d, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment")


@R.add("a25_speedup", """
WITH a AS (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1), b AS (SELECT m FROM a WHERE o_orderpriority = '1-URGENT')
SELECT o_orderpriority, round(100.0 * (a.m - b.m) / b.m, 4) AS percent FROM a, b""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    """Per cent against a named baseline row (one row, so it is broadcast)."""
    a = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    base = a.where("o_orderpriority = '1-URGENT'").agg(F.max("m").alias("b"))
    return a.join(F.broadcast(base)).select("o_orderpriority", F.round(F.lit(100.0) * (F.col("m") - F.col("b")) / F.col("b"), 4).alias("percent"))


@R.add("a29_two_medians", "SELECT l_shipmode_like AS variant, round(median(l_quantity), 4) AS median_quantity, round(median(l_extendedprice), 4) AS median_price FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1")
def a29(spark: SparkSession, d: str) -> DataFrame:
    """Two medians by variant."""
    lines = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("variant"), "l_quantity", "l_extendedprice")
    middle = lambda value, name: ranks.interpolated(lines, ["variant"], value, {name: 0.5}).withColumn(name, F.round(name, 4))
    return middle("l_quantity", "median_quantity").join(middle("l_extendedprice", "median_price"), "variant")


def _rank_sql(kind: str) -> str:
    rank = {"a4": "round_even({q} * (n - 1), 0)", "a5": "round({q} * (n - 1))", "a6": "floor({q} * (n - 1))"}[kind]
    cols = ", ".join(f"round(v[{rank.format(q=q)}::BIGINT + 1], 4) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95))
    return f"SELECT event_type, {cols} FROM (SELECT event_type, list(value ORDER BY value) AS v, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"


for _kind, _mode in (("a4", "half_even"), ("a5", "half_away"), ("a6", "floor")):

    @R.add(f"{_kind}_nearest_rank", _rank_sql(_kind))
    def nearest(spark: SparkSession, d: str, mode: str = _mode) -> DataFrame:
        """Nearest-rank percentiles in the three roundings, exact and distributed."""
        got = ranks.nearest_rank(table(spark, d, "events"), ["event_type"], "value", {f"p{int(q * 100)}": (q, mode) for q in (0.5, 0.9, 0.95)})
        return got.select("event_type", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "p95")])


@R.add("j2_case_or_reason", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN l.quality = 0 THEN 'poor' ELSE 'ok' END AS reason
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def j2(spark: SparkSession, d: str) -> DataFrame:
    """Left join, with a reason where the other side is missing."""
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    joined = table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("there").isNull(), "no label").when(F.col("quality") == 0, "poor").otherwise("ok").alias("reason"))


@R.add("j5_display_lookup", "SELECT c_custkey, coalesce(n_name, 'unknown') AS display, coalesce(r_name, 'none') AS category FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def j5(spark: SparkSession, d: str) -> DataFrame:
    """Code to display and category, by small fixed dimensions."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    joined = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return joined.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("display"), F.coalesce("r_name", F.lit("none")).alias("category"))


#: The rules that the routing query applies (id, target, states, codes, least confidence, priority, active).
RULES = [
    ("r1", "north", ["France", "GERMANY", "Russia"], [], 0.0, 10, True),
    ("r2", "asia", ["CHINA", "JAPAN", "INDIA"], ["AUTOMOBILE", "BUILDING"], 1000.0, 20, True),
    ("r3", "asia late", ["CHINA", "JAPAN"], [], -2000.0, 5, True),
    ("r4", "off", ["BRAZIL"], [], 0.0, 99, False),
    ("r5", "americas", ["BRAZIL", "CANADA", "PERU"], ["MACHINERY"], 0.0, 1, True),
    ("r6", "tie", ["FRANCE"], [], 0.0, 10, True),
]

_RULE_ROWS = ", ".join(f"('{i}', '{t}', {[x.upper() for x in s]}, {c or '[]::VARCHAR[]'}, {m}, {p})" for i, t, s, c, m, p, a in RULES if a)


@R.add("j7_rule_routing", f"""
WITH rules(rule_id, target, states, codes, least, priority) AS (VALUES {_RULE_ROWS}),
cases AS (SELECT c_custkey, upper(n_name) AS s, c_mktsegment, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey),
best AS (SELECT c_custkey, rule_id, target, row_number() OVER (PARTITION BY c_custkey ORDER BY priority DESC, rule_id) AS r
         FROM cases JOIN rules ON list_contains(states, s) AND (len(codes) = 0 OR list_contains(codes, c_mktsegment)) AND c_acctbal >= least)
SELECT c.c_custkey, b.rule_id, coalesce(b.target, CASE WHEN c.s IN (SELECT unnest(states) FROM rules) THEN 'Out of state' ELSE 'Unknown' END) AS target
FROM cases c LEFT JOIN best b ON b.c_custkey = c.c_custkey AND b.r = 1""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """First active rule by priority."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation").select("n_nationkey", "n_name")
    cases = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", F.array("c_mktsegment").alias("codes"), "c_acctbal")
    rules = spark.createDataFrame(RULES, "rule_id string, target string, states array<string>, codes array<string>, min_confidence double, priority int, active boolean")
    return routing.route(cases, rules, "c_custkey", "n_name", "codes", "c_acctbal").select("c_custkey", "rule_id", "target")


@R.add("j11_pareto", """
SELECT o_orderkey, o_totalprice, o_custkey FROM orders t WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_totalprice >= t.o_totalprice AND o.o_custkey >= t.o_custkey AND (o.o_totalprice > t.o_totalprice OR o.o_custkey > t.o_custkey))""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Rows that no other row dominates."""
    return pareto.front(table(spark, d, "orders"), "o_totalprice", "o_custkey").select("o_orderkey", "o_totalprice", "o_custkey")


@R.add("j17_uncovered_urls", """
WITH p AS (SELECT page_id, regexp_extract(url, '[^/]+$') AS base FROM pages), l AS (SELECT DISTINCT 'p' || (user_id)::VARCHAR AS base FROM events)
SELECT page_id, base FROM p WHERE base NOT IN (SELECT base FROM l)""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    """Base names of URLs that a local list lacks."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "[^/]+$", 0).alias("base"))
    local = table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("base")).distinct()
    return p.join(local, "base", "left_anti").select("page_id", "base")


@R.add("k3_status_merge", """
SELECT o_orderkey, coalesce(u.s, o_orderstatus) AS o_orderstatus, u.s IS NOT NULL AS touched
FROM orders LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS s FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1) u ON u.user_id = o_orderkey""")
def k3(spark: SparkSession, d: str) -> DataFrame:
    """Newest allowed status by key, with what was touched."""
    log = table(spark, d, "events").select(F.col("user_id").alias("o_orderkey"), F.col("event_type").alias("o_orderstatus"), F.col("event_id").alias("seq"))
    out = merge.set_status(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), log, "o_orderkey", "o_orderstatus", "seq", ["view", "click", "purchase"])
    return out.select("o_orderkey", "o_orderstatus", "touched")


@R.add("k4_upsert", """
SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT s_suppkey, s_name, round(s_acctbal, 2) FROM supplier""")
def k4(spark: SparkSession, d: str) -> DataFrame:
    """Delete by key and insert, on immutable tables."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.round("s_acctbal", 2).alias("c_acctbal"))
    return merge.upsert(c, s, ["c_custkey"])


@R.add("k5_delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus = 'P' OR o_totalprice < 5000, false)")
def k5(spark: SparkSession, d: str) -> DataFrame:
    """K5: what a delete leaves."""
    o = table(spark, d, "orders")
    return merge.delete_where(o, (F.col("o_orderstatus") == "P") | (F.col("o_totalprice") < 5000)).select("o_orderkey", "o_orderstatus")


@R.add("k7_timeline", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey")
def k7(spark: SparkSession, d: str) -> DataFrame:
    """K7: an ordered view."""
    table(spark, d, "orders").where("o_orderstatus = 'O'").createOrReplaceTempView("casegrid_timeline")
    return spark.sql("SELECT o_orderkey, o_orderdate, o_totalprice FROM casegrid_timeline ORDER BY o_orderdate, o_orderkey")


@R.add("p_filters", """
SELECT event_id, event_type, coalesce(CAST(value AS BIGINT)::VARCHAR, '-') AS shown,
       CASE WHEN value IS NULL THEN '-' WHEN value >= 50 THEN '+' || (CAST(floor(value) AS BIGINT) - 50)::VARCHAR ELSE (CAST(floor(value) AS BIGINT) - 50)::VARCHAR END AS signed
FROM events WHERE event_type IN ('view', 'click', 'error') AND event_type != 'error' AND props LIKE '{"k%' AND value IS NOT NULL AND value >= 10 AND value <= 90""".replace("CAST(value AS BIGINT)::VARCHAR", "CAST(floor(value) AS BIGINT)::VARCHAR"))
def p_filters(spark: SparkSession, d: str) -> DataFrame:
    """Predicates and display strings; all filters reach the scan."""
    e = table(spark, d, "events")
    kept = e.where(F.col("event_type").isin("view", "click", "error") & (F.col("event_type") != "error") & F.col("props").like('{"k%') & F.col("value").isNotNull() & (F.col("value") >= 10) & (F.col("value") <= 90))
    whole = F.floor("value").cast("long")
    sign = F.when(F.col("value").isNull(), "-").when(F.col("value") >= 50, F.concat(F.lit("+"), (whole - 50).cast("string"))).otherwise((whole - 50).cast("string"))
    return kept.select("event_id", "event_type", F.coalesce(whole.cast("string"), F.lit("-")).alias("shown"), sign.alias("signed"))


@R.add("p11_visibility", """
WITH m AS (SELECT max(ts) AS now FROM events)
SELECT event_id FROM events, m WHERE NOT (event_type = 'purchase' AND ts < now - INTERVAL 48 HOUR)""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    """Submitted rows disappear after 48 hours."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now)).where(~((F.col("event_type") == "purchase") & (F.col("ts") < F.col("now") - F.expr("interval 48 hours")))).select("event_id")


@R.add("p14_review_counts", """
SELECT l_orderkey, count(*)::BIGINT AS n, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END)::BIGINT AS kept, bool_or(l_returnflag = 'R') AS needs_review FROM lineitem GROUP BY 1""")
def p14(spark: SparkSession, d: str) -> DataFrame:
    """State counts and whether any needs review."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("kept"), F.bool_or(F.col("l_returnflag") == "R").alias("needs_review"))


@R.add("p19_deidentify", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS birth_year, substr(o_custkey::VARCHAR, 1, 3) AS zip3, sha256(o_orderpriority) AS digest, length(o_orderpriority)::INTEGER AS n_chars FROM orders")
def p19(spark: SparkSession, d: str) -> DataFrame:
    """Year, area prefix, digest and length in place of the values."""
    return table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("birth_year"), F.substring(F.col("o_custkey").cast("string"), 1, 3).alias("zip3"),
        F.sha2("o_orderpriority", 256).alias("digest"), F.length("o_orderpriority").alias("n_chars"),
    )


@R.add("p22_defaults", "SELECT c_custkey, coalesce(o.n, 0)::BIGINT AS n, coalesce(o.last_status, 'none') AS last_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey")
def p22(spark: SparkSession, d: str) -> DataFrame:
    """Defaults for what is missing."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last_status", F.lit("none")).alias("last_status"))


@R.add("s17_names_by_priority", """
SELECT code, name FROM (SELECT code, name, row_number() OVER (PARTITION BY code ORDER BY p, name) AS r FROM (
  SELECT s_suppkey AS code, s_name AS name, 0 AS p FROM supplier UNION ALL SELECT p_partkey, p_name, 1 FROM part)) WHERE r = 1""")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """One name a code, from the source of the best priority."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.struct(F.lit(0).alias("p"), F.col("s_name").alias("name")).alias("x"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.struct(F.lit(1).alias("p"), F.col("p_name").alias("name")).alias("x"))
    return s.unionByName(p).groupBy("code").agg(F.min("x").alias("x")).select("code", F.col("x.name").alias("name"))


@R.add("w3_waterfall", """
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT month, round(total, 2) AS total, round(100.0 * (total - first_value(total) OVER (ORDER BY month)) / first_value(total) OVER (ORDER BY month), 4) AS percent FROM m""")
def w3(spark: SparkSession, d: str) -> DataFrame:
    """Change against the first month; the window runs over months, not rows."""
    m = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    first = F.first("total").over(Window.orderBy("month"))
    return m.select("month", F.round("total", 2).alias("total"), F.round(F.lit(100.0) * (F.col("total") - first) / first, 4).alias("percent"))


@R.add("top_ranked", """
SELECT * FROM (SELECT 'best' AS kind, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'worst', p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 3)""")
def top_ranked(spark: SparkSession, d: str) -> DataFrame:
    """SURVEY 2.7: best and worst, each a top-k without a full sort."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    best = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(3).select(F.lit("best").alias("kind"), "*")
    return best.unionByName(p.orderBy("p_retailprice", "p_partkey").limit(3).select(F.lit("worst").alias("kind"), "*"))


@R.add("o9_checked_union", "SELECT n_nationkey, n_name FROM nation")
def o9(spark: SparkSession, d: str) -> DataFrame:
    """Union of overlapping parts, failing on a key with two different rows."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return merge.union_checked([n.where("n_nationkey < 15"), n.where("n_nationkey >= 10")], "n_nationkey")
