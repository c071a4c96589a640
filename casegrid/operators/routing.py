"""Rule routing: the first active rule by priority that matches a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def route(cases: DataFrame, rules: DataFrame, case_id: str, state: str, codes: str, confidence: str) -> DataFrame:
    """case columns, then rule_id and target; rules: rule_id, target, states[], codes[] (empty: any), min_confidence, priority, active.

    Each rule becomes one row a state, so the match is an equality join on the
    upper-cased state; code and confidence tests follow, then the best rule
    (highest priority, then lowest id). Cases in a state without any rule get
    'Unknown', others without a match 'Out of state'.
    """
    active = rules.where("active").select("rule_id", "target", F.explode("states").alias("s"), F.col("codes").alias("rule_codes"), "min_confidence", "priority").withColumn("s", F.upper("s"))
    own = cases.withColumn("s", F.upper(F.col(state)))
    match = own.join(active, "s").where(((F.size("rule_codes") == 0) | F.arrays_overlap("rule_codes", codes)) & (F.col(confidence) >= F.col("min_confidence")))
    best = Window.partitionBy(case_id).orderBy(F.desc("priority"), "rule_id")
    first = match.withColumn("r", F.row_number().over(best)).where("r = 1").select(case_id, "rule_id", "target")
    known = active.select("s").distinct().withColumn("known", F.lit(True))
    out = own.join(first, case_id, "left").join(known, "s", "left")
    return out.withColumn("target", F.coalesce("target", F.when(F.col("known"), "Out of state").otherwise("Unknown"))).drop("s", "known")
