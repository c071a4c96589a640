"""Scans over a subject's rows in order of time, for subjects of any size.

A window over a subject is one task's work. Subjects of more than ``most`` rows are
therefore cut at quantiles of their times into segments, which are scanned by
themselves; what a segment needs of those before it (last row, running totals) is
carried by a small table with one row for each segment, and trailing frames get the
rows just before their segment as copies that leave again. Other subjects are one
segment, and where there is no large one the plan is the plain window.

Times are numbers or timestamps that have an order; rows of one time are always in
one segment, so a subject whose rows all have one time stays whole. Null times come
first. Null keys are a subject. The number of large subjects is at most the number of
all rows over ``most``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a subject from which it is cut, and cuts
MOST, CUTS = 5_000_000, 255

SEGMENT, STARTS, GHOST = "segment__", "starts__", "ghost__"


@dataclass(frozen=True)
class Cut:
    """Rows with their segment and the starts of their subject's segments (null where it is whole)."""

    rows: DataFrame
    key: str
    any_large: bool

    def window(self, *order: str | Column):
        return Window.partitionBy(self.key, *[SEGMENT] * self.any_large).orderBy(*order)

    def carried(self, totals: dict[str, Column], over: dict[str, Callable[[Column], Column]]) -> DataFrame:
        """The rows with a column for each of ``totals``: aggregates of a segment, combined over the segments before it by ``over``."""
        large = self.rows.where(F.col(STARTS).isNotNull())
        of_segment = large.groupBy(self.key, SEGMENT).agg(*[c.alias(k) for k, c in totals.items()])
        before = Window.partitionBy(self.key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)  # at most CUTS + 1 rows
        carry = of_segment.select(F.col(self.key).alias("k__"), F.col(SEGMENT).alias("s__"), *[over[k](F.col(k)).over(before).alias(k) for k in totals])
        return self.rows.join(carry, self.rows[self.key].eqNullSafe(F.col("k__")) & (self.rows[SEGMENT] == F.col("s__")), "left").drop("k__", "s__")


def cut(rows: DataFrame, key: str, at: str, most: int = MOST, cuts: int = CUTS) -> Cut:
    large = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col(key).alias("k__"))
    if large.isEmpty():
        return Cut(rows, key, False)
    listed = [r["k__"] for r in large.collect()]  # at most all rows / most
    chosen = F.col(key).isin([k for k in listed if k is not None]) | (F.col(key).isNull() if None in listed else F.lit(False))
    quantiles = F.percentile_approx(F.col(at), [k / (cuts + 1) for k in range(1, cuts + 1)], 100 * (cuts + 1))
    starts = rows.where(chosen & F.col(at).isNotNull()).groupBy(F.col(key).alias("k__")).agg(F.array_distinct(quantiles).alias(STARTS))
    joined = rows.join(F.broadcast(starts), F.col(key).eqNullSafe(F.col("k__")), "left").drop("k__")
    # comparisons of sorted starts; a null time is before all of them
    segment = F.when(F.col(STARTS).isNull() | F.col(at).isNull(), 0).otherwise(F.size(F.filter(STARTS, lambda b: b <= F.col(at))))
    return Cut(joined.withColumn(SEGMENT, segment), key, True)


def with_prior(rows: DataFrame, key: str, at: str, tie: str, columns: dict[str, str], most: int = MOST, cuts: int = CUTS) -> DataFrame:
    """New column -> value of the row just before in order of (at, tie); null for the first."""
    c = cut(rows, key, at, most, cuts)
    values = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    inside = F.lag(values).over(c.window(at, tie))
    if not c.any_large:
        return rows.withColumn("p__", inside).select("*", *[F.col("p__")[new].alias(new) for new in columns]).drop("p__")
    last = F.max_by(values, F.struct(F.col(at), F.col(tie)))
    held = c.carried({"c__": last}, {"c__": lambda x: F.last(x, ignorenulls=True)})
    made = held.withColumn("p__", F.coalesce(inside, F.when(F.row_number().over(c.window(at, tie)) == 1, F.col("c__"))))
    return made.select(*rows.columns, *[F.col("p__")[new].alias(new) for new in columns])


def running(rows: DataFrame, key: str, at: str, tie: str | None, aggregates: dict[str, tuple[str, str]], most: int = MOST, cuts: int = CUTS) -> DataFrame:
    """New column -> (``max``, ``min``, ``sum`` or ``count``, column or ``*``) over the rows up to each in order of (at, tie); with no ``tie`` over the rows of strictly earlier times."""
    c = cut(rows, key, at, most, cuts)
    kinds: dict[str, Callable] = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    joins: dict[str, Callable[[Column, Column], Column]] = {
        "max": F.greatest, "min": F.least,
        "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    }
    of = lambda kind, column: kinds[kind](F.lit(1) if column == "*" else F.col(column))
    if tie is None:
        w = c.window(F.col(at)).rangeBetween(Window.unboundedPreceding, -1)
    else:
        w = c.window(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not c.any_large:
        return rows.select("*", *[of(kind, column).over(w).alias(new) for new, (kind, column) in aggregates.items()])
    again = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}
    held = c.carried({f"{new}__": of(kind, column) for new, (kind, column) in aggregates.items()}, {f"{new}__": again[kind] for new, (kind, _) in aggregates.items()})
    return held.select(*rows.columns, *[joins[kind](of(kind, column).over(w), F.col(f"{new}__")).alias(new) for new, (kind, column) in aggregates.items()])


def trailing_time(rows: DataFrame, key: str, at: str, width: int, aggregates: dict[str, Column], most: int = MOST, cuts: int = CUTS) -> DataFrame:
    """Aggregates over the rows from ``width`` before each row's time up to it (rows of its own time too); ``at`` is a number.

    Meant for windows shorter than a segment: a row is copied into each segment that its window reaches.
    """
    c = cut(rows, key, at, most, cuts)
    frame = lambda w: w.rangeBetween(-width, 0)
    if not c.any_large:
        return rows.select("*", *[a.over(frame(c.window(at))).alias(new) for new, a in aggregates.items()])
    reached = F.filter(F.sequence(F.col(SEGMENT) + 1, F.size(STARTS)), lambda s: F.element_at(STARTS, s) - F.col(at) <= width)
    own = F.struct(F.col(SEGMENT).alias("s"), F.lit(False).alias("ghost"))
    copies = F.when(F.col(STARTS).isNotNull() & F.col(at).isNotNull() & (F.size(STARTS) > F.col(SEGMENT)), F.transform(reached, lambda s: F.struct(s.alias("s"), F.lit(True).alias("ghost"))))
    dealt = c.rows.withColumn("d__", F.explode(F.concat(F.array(own), F.coalesce(copies, F.array().cast("array<struct<s:int,ghost:boolean>>")))))
    dealt = dealt.withColumns({SEGMENT: F.col("d__.s"), GHOST: F.col("d__.ghost")})
    w = frame(Window.partitionBy(key, SEGMENT).orderBy(at))
    return dealt.select("*", *[a.over(w).alias(new) for new, a in aggregates.items()]).where(~F.col(GHOST)).select(*rows.columns, *aggregates)


def trailing_rows(rows: DataFrame, key: str, at: str, tie: str, n: int, aggregates: dict[str, Column], most: int = MOST, cuts: int = CUTS) -> DataFrame:
    """Aggregates over each row and the ``n - 1`` before it in order of (at, tie); large subjects are dealt by row number."""
    numbered = running(rows, key, at, tie, {"rn__": ("count", "*")}, most, cuts)
    size = max(most, 2 * n)
    block = F.floor((F.col("rn__") - 1) / size).cast("long")
    copied = (F.col("rn__") - 1) % size > size - n
    dealt = numbered.withColumn("d__", F.explode(F.when(copied, F.array(F.struct(block.alias("b"), F.lit(False).alias("ghost")), F.struct((block + 1).alias("b"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(block.alias("b"), F.lit(False).alias("ghost"))))))
    w = Window.partitionBy(key, "d__.b").orderBy("rn__").rowsBetween(1 - n, 0)
    return dealt.select("*", *[a.over(w).alias(new) for new, a in aggregates.items()]).where(~F.col("d__.ghost")).select(*rows.columns, *aggregates)
