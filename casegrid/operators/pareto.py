"""Two-dimensional Pareto front: rows that no other row dominates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def front(df: DataFrame, x: str, y: str, cuts: int = 64) -> DataFrame:
    """Rows of ``df`` where no row is at least as large in both and larger in one; ties on the front all stay; nulls never do.

    The best y of each x is cut into about ``cuts`` ranges of x by a mergeable
    sketch (a bound on cost, not on results). A range's rows are first held
    against the best y of all ranges above, which leaves few, then against each
    other. No step orders all rows.
    """
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    best = points.groupBy("x").agg(F.max("y").alias("y"))
    sketch = points.agg(F.percentile_approx("x", [k / cuts for k in range(1, cuts)], 1000).alias("cut"))
    ranged = best.crossJoin(F.broadcast(sketch)).select("x", "y", F.size(F.filter(F.coalesce("cut", F.array().cast("array<double>")), lambda c: c < F.col("x"))).alias("part"))
    tops = ranged.groupBy("part").agg(F.max("y").alias("top"))
    over = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    above = tops.select("part", F.max("top").over(over).alias("above"))  # a row a range
    left = ranged.join(F.broadcast(above), "part").where("above is null or y > above")
    inside = Window.partitionBy("part").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    kept = left.withColumn("before", F.max("y").over(inside)).where("before is null or y > before").select(F.col("x").alias("__x"), F.col("y").alias("__y"))
    return df.join(kept, (df[x].cast("double") == F.col("__x")) & (df[y].cast("double") == F.col("__y")), "left_semi")
