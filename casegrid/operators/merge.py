"""Table maintenance on immutable tables: upsert, last write wins, delete, seed, union with a conflict check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``target`` whose key is not in ``changes``, and all of ``changes``."""
    return target.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def last_write(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; a row past every other in ``order`` wins (map-side maximum, no window)."""
    rest = [c for c in log.columns if c not in key]
    newest = log.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("row"))
    return newest.select(*[F.col(c) if c in key else F.col(f"row.{c}") for c in log.columns])


def set_status(table: DataFrame, updates: DataFrame, key: str, status: str, order: str, allowed: list[str] | None = None) -> DataFrame:
    """``table`` with the newest allowed status of ``updates`` (key, status, order) and whether it was touched."""
    if allowed is not None:
        updates = updates.where(F.col(status).isin(allowed))
    new = last_write(updates.select(key, status, order), [key], [order]).select(key, F.col(status).alias("__new"))
    joined = table.join(new, key, "left")
    return joined.withColumn("touched", F.col("__new").isNotNull()).withColumn(status, F.coalesce("__new", status)).drop("__new")


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or null stay."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def seed_if_empty(table: DataFrame, seed: DataFrame) -> DataFrame:
    return seed if table.isEmpty() else table


def split_updates(updates: DataFrame, table: DataFrame, key: str, status: str, allowed: list[str]) -> DataFrame:
    """``updates`` with ``reject``: why a row can't be applied (unknown status, no such key), null where it can."""
    known = table.select(key).distinct().withColumn("__known", F.lit(True))
    joined = updates.join(known, key, "left")
    reason = F.when(~F.coalesce(F.col(status).isin(allowed), F.lit(False)), "invalid status").when(F.col("__known").isNull(), "not found")
    return joined.withColumn("reject", reason).drop("__known")


def apply_statuses(table: DataFrame, updates: DataFrame, key: str, status: str, order: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table after the newest good update of each key, one row of counts: updated keys, and rejected rows by reason)."""
    judged = split_updates(updates, table, key, status, allowed)
    after = set_status(table, judged.where("reject is null"), key, status, order)
    counts = judged.agg(
        F.count_distinct(F.when(F.col("reject").isNull(), F.col(key))).alias("updated"),
        F.count_if(F.col("reject") == "invalid status").alias("invalid"),
        F.count_if(F.col("reject") == "not found").alias("missing"),
    )
    return after, counts


def union_checked(parts: list[DataFrame], key: str) -> DataFrame:
    """Union without repeats; the query fails if a key has different rows. Rows meet by a group, so that a key that repeats shrinks before the shuffle."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    row = F.struct(*out.columns)
    one = out.groupBy(key).agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    clash = F.raise_error(F.concat(F.lit(f"different rows for {key} "), F.col(key).cast("string")))
    return one.where(F.when(F.col("lo").eqNullSafe(F.col("hi")), F.lit(True)).otherwise(clash.cast("boolean"))).select(*[F.col("lo").getField(c).alias(c) for c in out.columns])


def migrate(old: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns that are missing, as null of the given type."""
    return old.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in old.columns])
