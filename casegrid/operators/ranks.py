"""Exact order statistics of groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: how a fraction of n - 1 becomes a rank
MODES = {
    "half_even": lambda x: F.bround(x, 0),
    "half_away": lambda x: F.round(x, 0),
    "floor": F.floor,
    "ceil": F.ceil,
}


def nearest_rank(df: DataFrame, group: list[str], value: str, wanted: dict[str, tuple[float, str]], cuts: int = 64, count: str | None = None) -> DataFrame:
    """``group`` columns and one column for each entry of ``wanted``: name -> (fraction, mode); under ``count``, if named, how many values there are.

    Rows of a group are cut into about ``cuts`` value ranges by a mergeable
    sketch; counts by range tell which ranges hold the wanted ranks, and only
    those are ordered. The sketch steers cost alone: ranks are exact.
    """
    rows = df.select(*group, F.col(value).cast("double").alias("v")).where("v is not null")
    marks = [i / cuts for i in range(1, cuts)]
    sketch = rows.groupBy(*group).agg(F.count("*").alias("n"), F.percentile_approx("v", marks, 1000).alias("cut"))
    cut = rows.join(sketch, group) if group else rows.crossJoin(F.broadcast(sketch))
    ranged = cut.select(*group, "v", "n", F.size(F.filter("cut", lambda c: c < F.col("v"))).alias("part"))
    counts = ranged.groupBy(*group, "part").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), MODES[mode](F.lit(q) * (F.col("n") - 1)).cast("long").alias("rank")) for name, (q, mode) in wanted.items()])
    hit = counts.select(*group, "part", "before", "c", "n", F.explode(ranks).alias("w")).where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("c")))
    parts = hit.groupBy(*group, "part").agg(F.first("before").alias("before"), F.first("n").alias("all"), F.collect_list("w").alias("w"))
    inside = Window.partitionBy(*group, "part").orderBy("v")
    found = ranged.drop("n").join(parts, [*group, "part"]).withColumn("rank", F.row_number().over(inside) - 1 + F.col("before"))
    found = found.select(*group, "v", "all", "rank", F.explode("w").alias("w")).where("rank = w.rank")
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in wanted], *([F.first("all").alias(count)] if count else []))


def interpolated(df: DataFrame, group: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``group`` columns and a percentile for each entry of ``wanted`` (name -> fraction), between the two nearest ranks."""
    ends = {f"{name}_{mode}": (q, mode) for name, q in wanted.items() for mode in ("floor", "ceil")}
    joined = nearest_rank(df, group, value, ends, count="n")
    between = lambda name, q: F.col(f"{name}_floor") + (F.col(f"{name}_ceil") - F.col(f"{name}_floor")) * (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)))
    return joined.select(*group, *[between(name, q).alias(name) for name, q in wanted.items()])


def pick(values: Column, n: Column, fraction: float, mode: str) -> Column:
    """The same on a sorted array column of known small size."""
    return F.element_at(values, (MODES[mode](F.lit(fraction) * (n - 1)) + 1).cast("int"))
