"""Decisions on rows and traces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decision(axis: Column, review: Column, category: Column, enabled: list[str], need_review: bool) -> Column:
    """First of: rejected; review still needed; not a condition; category unknown; category enabled or not."""
    return (
        F.when(F.coalesce(review == "rejected", F.lit(False)), "not_included")
        .when(F.lit(need_review) & F.coalesce(review == "needs_review", F.lit(False)), "needs_review")
        .when(axis != "condition", "reportable")
        .when(category.isNull(), "needs_review")
        .when(category.isin(enabled) if enabled else F.lit(False), "reportable")
        .otherwise("not_included")
    )


def perfect(matched: Column, expected: Column, false_positives: Column) -> Column:
    """All found and nothing else; false where a count is missing."""
    return F.coalesce((matched == expected) & (false_positives == 0), F.lit(False))


def validated(trace: Column) -> Column:
    """Some validation step is valid without issues; trace: array of struct(tool_result, valid, issues)."""
    ok = F.exists(trace, lambda t: (t["tool_result"] == "validate_fhir_extraction") & t["valid"] & (F.coalesce(F.size(t["issues"]), F.lit(0)) <= 0))
    return F.coalesce(ok, F.lit(False))


def in_mode(mode: str, hard_negative: Column, corrected: Column) -> Column:
    """All rows, hard negatives, or corrections."""
    return {"all": F.lit(True), "hard-negatives": hard_negative, "corrections": corrected}[mode]


def grounded(hits: DataFrame, query_id: str, score: float = 0.4) -> DataFrame:
    """For each query the first hit of at least ``score`` in SNOMED, unless the query is denied everywhere (column ``denied``)."""
    kept = hits.where((F.col("score") >= score) & (F.upper("system") == "SNOMED") & ~F.col("denied"))
    r = F.row_number().over(Window.partitionBy(query_id).orderBy("rank"))
    return kept.withColumn("r", r).where("r = 1").drop("r")


def merged_chunks(parts: DataFrame, doc: str, chunk: str, codes: str, salvage: str) -> DataFrame:
    """Codes of a document in order of chunks, each chunk's own or, where it has none, those salvaged from its tool result."""
    own = F.when(F.size(codes) > 0, F.col(codes)).otherwise(F.coalesce(salvage, F.array().cast("array<string>")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("i"), own.alias("c"))))
    return parts.groupBy(doc).agg(listed.alias("l")).select(doc, F.array_distinct(F.flatten(F.transform("l", lambda x: x["c"]))).alias(codes))


_FILE = re.compile(r"(?m)^\s*Validate\s+(\S+)")
_SUMMARY = re.compile(r"(\d+)\s+errors?,\s*(\d+)\s+warnings?")


def validator_log(logs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Id, file, errors, warnings, valid for each file's block of a validator log; a block without a summary is invalid."""
    kind = dict(logs.dtypes)[id_column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, log in zip(batch[id_column], batch[text]):
                marks = list(_FILE.finditer(log or ""))
                for m, after in zip(marks, [*(n.start() for n in marks[1:]), len(log or "")]):
                    found = _SUMMARY.search(log, m.end(), after)
                    rows.append((key, m.group(1), int(found.group(1)) if found else None, int(found.group(2)) if found else None, bool(found and found.group(1) == "0")))
            out = pd.DataFrame(rows, columns=[id_column, "file", "errors", "warnings", "valid"])
            yield out.astype({"errors": "Int64", "warnings": "Int64"})

    return logs.select(id_column, text).mapInPandas(run, f"{id_column} {kind}, file string, errors long, warnings long, valid boolean")
