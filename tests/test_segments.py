"""Segmented scans equal plain windows, with a subject of a third of all rows, ties, nulls and one time for all."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casegrid.operators import segments

AGG = {"peak": ("max", "v"), "low": ("min", "v"), "total": ("sum", "v"), "n": ("count", "*"), "seen": ("count", "v")}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [(k, rng.choice([1, 1, 1, 2, 3, None, 4 + k % 9]), rng.choice([None, *range(40)]) if k % 7 == 0 else rng.randrange(3000), rng.choice([None, 1, 2, 5, -3]), f"r{k}") for k in range(900)]
    data += [(900 + k, 99, 5, k, "same time") for k in range(150)]
    return spark.createDataFrame(data, "id long, subject long, at long, v long, name string").repartition(5).cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("most", [50, 10**9])
def test_prior_and_running(rows, most):
    w = Window.partitionBy("subject").orderBy("at", "id")
    got = segments.with_prior(rows, "subject", "at", "id", {"prior_id": "id", "prior_v": "v"}, most, cuts=7)
    same(got, rows.select("*", F.lag("id").over(w).alias("prior_id"), F.lag("v").over(w).alias("prior_v")))
    plain = {"peak": F.max("v"), "low": F.min("v"), "total": F.sum("v"), "n": F.count(F.lit(1)), "seen": F.count("v")}
    got = segments.running(rows, "subject", "at", "id", AGG, most, cuts=7)
    same(got, rows.select("*", *[a.over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k, a in plain.items()]))
    timed = rows.where("at is not null")
    got = segments.running(timed, "subject", "at", None, AGG, most, cuts=7)
    same(got, timed.select("*", *[a.over(Window.partitionBy("subject").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)).alias(k) for k, a in plain.items()]))


@pytest.mark.parametrize("most", [50, 10**9])
def test_trailing(rows, most):
    for width in (0, 15, 100, 5000):
        plain = Window.partitionBy("subject").orderBy("at").rangeBetween(-width, 0)
        got = segments.trailing_time(rows, "subject", "at", width, {"n": F.count("*"), "first": F.min("at")}, most, cuts=7)
        same(got, rows.select("*", F.count("*").over(plain).alias("n"), F.min("at").over(plain).alias("first")))
    for n in (1, 2, 60):
        plain = Window.partitionBy("subject").orderBy("at", "id").rowsBetween(1 - n, 0)
        got = segments.trailing_rows(rows, "subject", "at", "id", n, {"s": F.sum("v"), "n": F.count("*")}, most, cuts=7)
        same(got, rows.select("*", F.sum("v").over(plain).alias("s"), F.count("*").over(plain).alias("n")))


def test_large_subject_is_spread(rows):
    c = segments.cut(rows, "subject", "at", 50, cuts=7)
    sizes = {(r["subject"], r[segments.SEGMENT]): r["count"] for r in c.rows.groupBy("subject", segments.SEGMENT).count().collect()}
    assert max(n for (s, _), n in sizes.items() if s == 1) < 120 and sum(s == 1 for s, _ in sizes) == 8
    assert sum(s == 5 for s, _ in sizes) == 1 and sum(s == 99 for s, _ in sizes) == 1
    assert not segments.cut(rows.limit(0), "subject", "at", 50).any_large
    same(segments.with_prior(rows.limit(0), "subject", "at", "id", {"p": "id"}), rows.limit(0).withColumn("p", F.col("id")))
