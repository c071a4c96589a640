"""Sinks: files with fixed shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: header of the flat diff table.
DIFF_HEADER = ["patient_hash", "case_id", "case_dt", "axis", "code_system", "code", "display", "change_type"]


def append(rows: DataFrame, path: str) -> None:
    """K1: insert."""
    rows.write.mode("append").parquet(path)


def diff_csv(rows: DataFrame, path: str) -> None:
    """K8: the flat diff with its fixed header, in order of date, axis, change, system and code; range-partitioned, so files in order of name are in order."""
    rows.select(*DIFF_HEADER).orderBy("case_dt", "axis", "change_type", "code_system", "code", "case_id").write.mode("overwrite").option("header", True).csv(path)


def jsonl(rows: DataFrame, path: str) -> None:
    """K9: compact JSON lines with sorted keys; null fields are left out."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("overwrite").text(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table for readers; the result must be small, and is refused otherwise."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows are no report")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in got)])


def split_dataset(rows: DataFrame, split: Column, path: str) -> DataFrame:
    """Rows by split in folders, and the manifest (split, n) as a table beside them."""
    marked = rows.withColumn("split", split)
    marked.write.mode("overwrite").partitionBy("split").json(f"{path}/rows")
    manifest = marked.sparkSession.read.json(f"{path}/rows").groupBy("split").agg(F.count("*").alias("n"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def diff_payload(rows: DataFrame, case: str, only_added: bool = False) -> DataFrame:
    """Case, payload: the changes of a case as JSON, each with its decision; ``only_added`` leaves the others out."""
    kept = rows.where(F.col("change_type") == "added") if only_added else rows
    listed = F.array_sort(F.collect_list(F.struct("axis", "change_type", "code", "decision")))
    return kept.groupBy(case).agg(listed.alias("changes")).select(case, F.to_json(F.struct(F.col(case), F.col("changes"))).alias("payload"))
