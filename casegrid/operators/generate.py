"""Seeded synthetic cases and the check of longitudinal fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.operators.visits import set_changes


def choose(options: list[str], seed: int, *parts: Column) -> Column:
    """One of the options by a hash of seed and parts: the same row always draws alike, on any partitioning."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(len(options))) + 1).cast("int"))


def cases(spark: SparkSession, n: int, terms: list[tuple[str, str]], templates: list[str], names: list[tuple[str, str]], seed: int = 1) -> DataFrame:
    """case_id, given, family, dob, user, expected_conditions: templates (with {name}, {term}, {code}) times demographics."""
    rows = spark.range(n).withColumnRenamed("id", "k")
    k = F.col("k")
    pair = lambda items, salt: F.split(choose(["\x1f".join(i) for i in items], seed + salt, k), "\x1f")
    rows = rows.select("k", pair(names, 1).alias("who"), pair(terms, 2).alias("term"), choose(templates, seed + 3, k).alias("template"), F.date_add(F.lit("1940-01-01").cast("date"), F.pmod(F.xxhash64(F.lit(seed + 4), k), F.lit(25000)).cast("int")).alias("dob"))
    text = F.col("template")
    for mark, value in (("{name}", F.concat_ws(" ", F.col("who")[0], F.col("who")[1])), ("{term}", F.col("term")[1]), ("{code}", F.col("term")[0])):
        text = F.replace(text, F.lit(mark), value)
    return rows.select(F.concat(F.lit("syn-"), k.cast("string")).alias("case_id"), F.col("who")[0].alias("given"), F.col("who")[1].alias("family"), F.col("dob").cast("string").alias("dob"), text.alias("user"), F.array(F.col("term")[0]).alias("expected_conditions"))


def check_visits(visits: DataFrame, codes: str, prior: str, expected: dict[str, str]) -> DataFrame:
    """All columns and ``ok``: do the changes of each visit equal the expected arrays? Missing expectations are not judged."""
    made = set_changes(F.col(codes), F.col(prior))
    same = [F.when(F.col(c).isNull(), F.lit(True)).otherwise(F.array_sort(F.col(c)) == made[k]) for k, c in expected.items()]
    ok = F.lit(True)
    for s in same:
        ok = ok & s
    return visits.withColumn("ok", ok)
