"""Selection of rows over buckets in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrid.session import work_folder


def round_robin(rows: DataFrame, row_id: str, bucket: str, limit: int) -> DataFrame:
    """One row of each bucket in turn, rare buckets first, until ``limit``; a row of several buckets is taken once: (row_id, turn).

    A claim is one turn of one bucket; its turns are ordered by round, then by the
    bucket's size, then its name. Every claim offers for its bucket's first row; of the
    claims that meet on a row the earliest keeps it, the others go on to the next row of
    their bucket that no earlier claim holds, until no claim has to move. That is what
    taking turns one after the other gives, since no claim can lose its row to a later
    one. Each step is a join and a map-side minimum over claims; nothing is gathered.

    A bucket's ``limit`` first rows are all it can need, and claims are made for as many
    rounds as ``limit`` takes. Null ids and null buckets are left out; rows that repeat
    count once; ``limit`` is the feature here.
    """
    pairs = rows.select(F.col(row_id).alias("id"), F.col(bucket).alias("bucket")).where("id is not null and bucket is not null").distinct()
    sizes = pairs.groupBy("bucket").agg(F.count("*").alias("n"))
    heads = pairs.withColumn("pos", F.row_number().over(Window.partitionBy("bucket").orderBy("id"))).where(F.col("pos") <= limit).join(sizes, "bucket")
    heads = _written(heads, "heads")
    buckets = heads.where("pos = 1").count()
    rounds = -(-limit // max(1, buckets))
    while True:
        claims = heads.where(F.col("pos") <= rounds).select("bucket", F.struct(F.col("pos").alias("round"), "n", "bucket").alias("turn"), "pos")
        held = _settled(heads, claims)
        if rounds >= limit or held.count() >= limit:
            break
        rounds = min(limit, 2 * rounds)  # some claims found nothing left: later rounds fill up
    first = held.select("id", "turn").orderBy("turn").limit(limit)
    numbered = first.withColumn("turn", F.row_number().over(Window.orderBy("turn")))  # ``limit`` rows
    return numbered.select(F.col("id").alias(row_id), "turn")


def _settled(heads: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, turn, ...) of the claims that hold a row in the end."""
    while True:
        offers = claims.join(heads.select("bucket", "pos", "id"), ["bucket", "pos"])
        holders = offers.groupBy("id").agg(F.min("turn").alias("holder"))
        judged = _written(offers.join(holders, "id"), "offers")
        lost = judged.where(F.col("turn") != F.col("holder"))
        if lost.isEmpty():
            return judged
        taken = judged.select("id", "holder").distinct()
        ahead = lost.select("bucket", "turn", "pos").join(heads.select("bucket", F.col("pos").alias("next"), "id"), "bucket").where("next > pos")
        free = ahead.join(taken, "id", "left").where("holder is null or turn < holder")
        moved = free.groupBy("bucket", "turn").agg(F.min("next").alias("pos"))
        claims = judged.where(F.col("turn") == F.col("holder")).select("bucket", "turn", "pos").unionByName(moved)


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and written to the shared folder."""
    path = work_folder(df.sparkSession, f"selection-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
