"""Scoring variants over extractions made of order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.operators import scores
from casegrid.plans.registry import Registry
from casegrid.session import table

R = Registry()

#: An order is a case: codes that its lines should give, by bucket, and codes that an extraction gave (some missed, some false, some in the wrong bucket).
_WANT = {"conditions": ("l_linenumber % 3 = 1", "l_partkey % 9"), "loincs": ("l_linenumber % 3 = 2", "l_suppkey % 7"), "rxnorms": ("l_linenumber % 3 = 0", "l_partkey % 5")}
_GOT = {"conditions": ("l_linenumber % 3 = 1", "(l_partkey + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END) % 9"), "loincs": ("l_linenumber % 3 = 2 AND l_partkey % 6 > 0", "l_suppkey % 7"), "rxnorms": ("l_linenumber % 3 = 0 OR l_linenumber = 7", "l_partkey % 5")}
_SQL = "WITH c AS (SELECT l_orderkey AS id, " + ", ".join(
    f"coalesce(list(({code})::BIGINT::VARCHAR ORDER BY l_linenumber, ({code})) FILTER (WHERE {when}), []) AS {name}_{bucket}" for name, side in (("want", _WANT), ("got", _GOT)) for bucket, (when, code) in side.items()
) + " FROM lineitem GROUP BY 1)"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """id, want_<bucket>, got_<bucket>: arrays in order of line; an order has few lines."""
    line = lambda when, code: F.expr(f"CASE WHEN {when} THEN struct(l_linenumber AS n, CAST({code} AS BIGINT) AS c) END")
    lists = [
        F.transform(F.array_sort(F.collect_list(line(*rule))), lambda x: x["c"].cast("string")).alias(f"{name}_{bucket}") for name, side in (("want", _WANT), ("got", _GOT)) for bucket, rule in side.items()
    ]
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(*lists)


def _sides() -> tuple[dict, dict]:
    return {b: F.col(f"want_{b}") for b in _WANT}, {b: F.col(f"got_{b}") for b in _GOT}


_FLAT = _SQL + """, f AS (SELECT id, list_concat(list_concat(list_distinct(want_conditions), list_distinct(want_loincs)), list_distinct(want_rxnorms)) AS w,
  list_concat(list_concat(list_distinct(got_conditions), list_distinct(got_loincs)), list_distinct(got_rxnorms)) AS g FROM c),
v2 AS (SELECT id, len(list_filter(w, lambda x: list_contains(g, x)))::INTEGER AS matched, len(w)::INTEGER AS expected, len(list_filter(g, lambda x: NOT list_contains(w, x)))::INTEGER AS fp FROM f)"""


@R.add("v2_flat_score", _FLAT + " SELECT * FROM v2")
def v2(spark: SparkSession, d: str) -> DataFrame:
    """V2: hits over all buckets together."""
    return _cases(spark, d).select("id", *[c.alias(k) for k, c in scores.flat_score(*_sides()).items()])


def _named(op) -> str:
    """SQL for the sorted ``bucket:code`` list of an operation on the two lists of each bucket."""
    parts = [f"list_transform(list_distinct({op(f'want_{b}', f'got_{b}')}), lambda x: '{b}:' || x)" for b in _WANT]
    return f"list_sort(list_concat(list_concat({parts[0]}, {parts[1]}), {parts[2]}))"


_MINUS = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


@R.add("v3_bucket_score", _SQL + f""", s AS (SELECT *, {_named(lambda w, g: f"list_filter({g}, lambda x: list_contains({w}, x))")} AS matched, {_named(_MINUS)} AS missing, {_named(lambda w, g: _MINUS(g, w))} AS spurious FROM c)
SELECT id, array_to_string(matched, ' ') AS matched, array_to_string(missing, ' ') AS missing, array_to_string(spurious, ' ') AS spurious,
 len(matched) = len(want_conditions) + len(want_loincs) + len(want_rxnorms) AND len(spurious) = 0 AS perfect FROM s""")
def v3(spark: SparkSession, d: str) -> DataFrame:
    """V3: matched, missing and spurious codes by bucket."""
    got = scores.bucket_score(*_sides())
    return _cases(spark, d).select("id", *[(c if k == "perfect" else F.array_join(c, " ")).alias(k) for k, c in got.items()])


@R.add("v5_verbatim", _SQL + """, t AS (SELECT *, array_to_string(got_conditions, ',') || ';' || array_to_string(got_rxnorms, ',') AS text FROM c),
m AS (SELECT id, len(want_conditions) + len(want_loincs) + len(want_rxnorms) AS e, array_to_string(list_filter(want_loincs, lambda x: contains(text, x)), ' ') AS matched_loincs,
 len(list_filter(list_concat(list_concat(want_conditions, want_loincs), want_rxnorms), lambda x: contains(text, x))) AS m FROM t)
SELECT id, matched_loincs, e::INTEGER AS total_expected, m::INTEGER AS total_matched, round(CASE WHEN e > 0 THEN m / e ELSE 0 END, 6) AS extraction_score FROM m""")
def v5(spark: SparkSession, d: str) -> DataFrame:
    """V5: expected codes that stand in the raw output."""
    text = F.concat(F.array_join("got_conditions", ","), F.lit(";"), F.array_join("got_rxnorms", ","))
    got = scores.verbatim_score(_sides()[0], text)
    return _cases(spark, d).select("id", F.array_join(got["matched_loincs"], " ").alias("matched_loincs"), got["total_expected"].alias("total_expected"), got["total_matched"].alias("total_matched"), F.round(got["extraction_score"], 6).alias("extraction_score"))


@R.add("v6_sweep", _FLAT + """, e AS (SELECT *, id % 5 AS temperature, CASE WHEN id % 17 = 0 THEN 'timeout' END AS error FROM v2),
s AS (SELECT temperature, sum((error IS NULL)::INT)::BIGINT AS n_cases, sum((error IS NOT NULL)::INT)::BIGINT AS errors, sum((error IS NULL AND expected > 0 AND matched = expected AND fp = 0)::INT)::BIGINT AS perfect,
 sum(matched) FILTER (error IS NULL)::BIGINT AS matched, sum(expected) FILTER (error IS NULL)::BIGINT AS expected, sum(fp) FILTER (error IS NULL)::BIGINT AS false_positives FROM e GROUP BY 1)
SELECT *, round(matched / (matched + false_positives), 4) AS precision, round(matched / expected, 4) AS recall, round(2 * matched / (matched + false_positives + expected), 4) AS f1 FROM s""")
def v6(spark: SparkSession, d: str) -> DataFrame:
    """V6: totals by temperature, errors apart."""
    cases = _cases(spark, d).select("id", *[c.alias(k) for k, c in scores.flat_score(*_sides()).items()])
    cases = cases.select("*", (F.col("id") % 5).alias("temperature"), F.when(F.col("id") % 17 == 0, "timeout").alias("error"))
    return scores.sweep(cases, ["temperature"])


def _record(side: str, vitals: dict) -> Column:
    """A record as JSON text: conditions with two code systems, labs, drugs, vital signs."""
    items = lambda bucket, *systems: F.transform(f"{side}_{bucket}", lambda x: F.struct(*[F.concat(F.lit(prefix), x).alias(s) for s, prefix in systems]))
    return F.to_json(
        F.struct(
            F.struct(F.lit("x").alias("name")).alias("patient"), items("conditions", ("snomed", ""), ("icd10", "A")).alias("conditions"), items("loincs", ("loinc", "")).alias("labs"),
            items("rxnorms", ("rxnorm", "")).alias("meds"), F.struct(*[c.alias(k) for k, c in vitals.items()]).alias("vitals"),
        )
    )


_TUPLES = lambda side, vitals: "list_distinct(list_concat(list_concat(list_concat(list_transform({0}_conditions, lambda x: 'snomed|' || x), list_transform({0}_conditions, lambda x: 'icd10|A' || x)), list_concat(list_transform({0}_loincs, lambda x: 'loinc|' || x), list_transform({0}_rxnorms, lambda x: 'rxnorm|' || x))), {1}))".format(side, vitals)
_RECORDS = _SQL + f""", t AS (SELECT id, id % 13 <> 1 AS json_valid, id % 13 > 2 AS schema_complete, {_TUPLES('want', "CASE WHEN id % 2 = 0 THEN ['vital|hr', 'vital|temp'] ELSE ['vital|temp'] END")} AS w,
 CASE WHEN id % 13 = 1 THEN []::VARCHAR[] WHEN id % 13 = 2 THEN {_TUPLES('got', '[]::VARCHAR[]')} WHEN id % 13 = 0 THEN []::VARCHAR[] ELSE {_TUPLES('got', "CASE WHEN id % 3 = 0 THEN ['vital|hr'] ELSE ['vital|temp', 'vital|bp'] END")} END AS g FROM c),
v4 AS (SELECT id, len(list_filter(w, lambda x: list_contains(g, x)))::INTEGER AS tp, len(list_filter(g, lambda x: NOT list_contains(w, x)))::INTEGER AS fp, len(list_filter(w, lambda x: NOT list_contains(g, x)))::INTEGER AS fn, json_valid, schema_complete FROM t)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Gold and predicted records as texts: of thirteen predictions one is cut off, one lacks its vital signs, and one is a list."""
    gold = _record("want", {"hr": F.when(F.col("id") % 2 == 0, F.lit(80)), "temp": F.lit("37.5"), "bp": F.lit("")})
    pred = _record("got", {"hr": F.when(F.col("id") % 3 == 0, F.lit(80)), "temp": F.when(F.col("id") % 3 != 0, F.lit("37.5")), "bp": F.when(F.col("id") % 3 != 0, F.lit("120/80"))})
    kind = F.col("id") % 13
    p = F.col("pred")
    text = F.when(kind == 1, F.concat(F.substring(p, 1, 40), F.lit(" ..."))).when(kind == 2, F.regexp_replace(p, ',"vitals":.*$', "}")).when(kind == 0, F.concat(F.lit("["), p, F.lit("]"))).otherwise(p)
    made = _cases(spark, d).select("id", gold.alias("gold"), pred.alias("pred")).select("id", "gold", text.alias("pred"))
    return made.select("id", scores.record_scored(F.col("gold"), F.col("pred")).alias("s")).select("id", "s.*")


@R.add("v4_record_score", _RECORDS + " SELECT * FROM v4")
def v4(spark: SparkSession, d: str) -> DataFrame:
    """Codes by system, and vital signs by name, of two JSON records."""
    return _scored(spark, d)


@R.add("a13_summary", _RECORDS + """, p AS (SELECT *, id % 4 AS run, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM v4)
SELECT run, count(*)::BIGINT AS n, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 4) AS macro_f1,
 round(avg(json_valid::INT), 4) AS json_valid_rate, round(avg(schema_complete::INT), 4) AS schema_complete_rate,
 round(sum(tp) / (sum(tp) + sum(fp)), 4) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 4) AS micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS micro_f1 FROM p GROUP BY run""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Micro and macro scores with the rates of valid and complete records."""
    return scores.summary(_scored(spark, d).withColumn("run", F.col("id") % 4), ["run"])
