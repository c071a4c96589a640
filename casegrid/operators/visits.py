"""Longitudinal operators: prior visit, added / removed / unchanged, duplicate flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_prior(df: DataFrame, subject: str, at: str, tie: str, columns: dict[str, str]) -> DataFrame:
    """Adds, under new names, columns of the row before in the subject's order (time, then ``tie``)."""
    w = Window.partitionBy(subject).orderBy(at, tie)
    return df.select("*", *[F.lag(old).over(w).alias(new) for new, old in columns.items()])


def seen_before(df: DataFrame, key: list[str], at: str, window: str, tick: str) -> Column:
    """Was there a row of the same key in the window before this row's time (its own time excluded)?

    ``window`` and ``tick`` are interval literals of one type, e.g. ``interval '2 00:00:00.000000' day to second``.
    """
    keys = ", ".join(key)
    return F.expr(f"count(1) over (partition by {keys} order by {at} range between {window} preceding and {tick} preceding) > 0")


def set_changes(current: Column, prior: Column) -> dict[str, Column]:
    """added, removed and unchanged members of two array columns, sorted; a missing prior changes nothing."""
    before = F.coalesce(prior, current)
    return {
        "added": F.array_sort(F.array_except(current, before)),
        "removed": F.array_sort(F.array_except(before, current)),
        "unchanged": F.array_sort(F.array_intersect(current, before)),
    }


def flat_changes(visits: DataFrame, subject: str, visit: str, codes: str, prior: str) -> DataFrame:
    """One row a (subject, visit, code): change_type; a first visit's codes are all unchanged."""
    parts = set_changes(F.col(codes), F.col(prior))

    def named(kind: str):
        return lambda code: F.struct(code.alias("code"), F.lit(kind).alias("change_type"))

    listed = F.concat(*[F.transform(c, named(kind)) for kind, c in parts.items()])
    return visits.select(subject, visit, F.explode(listed).alias("c")).select(subject, visit, "c.code", "c.change_type")


def entity_changes(visits: DataFrame, subject: str, visit: str, entities: str, prior: str) -> DataFrame:
    """One row a (subject, visit, axis, code_system, code): display and change_type; added and unchanged show the visit's own display, removed ones the prior's.

    ``entities`` and ``prior`` are arrays of struct(axis, code_system, code, display); of
    entities with one key in a visit the first counts. Without a prior all are unchanged.
    """
    none = F.array().cast("array<struct<axis:string,code_system:string,code:string,display:string>>")
    key = lambda x: F.struct(x["axis"], x["code_system"], x["code"])
    keys = lambda c: F.transform(c, key)
    first = lambda c: F.filter(c, lambda x, i: F.array_position(keys(c), key(x)) == i + 1)
    now = F.coalesce(first(F.col(entities)), none)
    before = F.coalesce(first(F.col(prior)), now)
    named = lambda c, kind: F.transform(c, lambda x: F.struct(x["axis"].alias("axis"), x["code_system"].alias("code_system"), x["code"].alias("code"), x["display"].alias("display"), F.lit(kind).alias("change_type")))
    parts = [
        named(F.filter(now, lambda x: ~F.array_contains(keys(before), key(x))), "added"),
        named(F.filter(before, lambda x: ~F.array_contains(keys(now), key(x))), "removed"),
        named(F.filter(now, lambda x: F.array_contains(keys(before), key(x))), "unchanged"),
    ]
    return visits.select(subject, visit, F.explode(F.concat(*parts)).alias("c")).select(subject, visit, "c.*")
