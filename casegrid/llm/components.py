"""Connected components of a link table, distributed: no link or label reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from casegrid.llm.common import forget, stored

#: a key with more rows than this, and than this share of all, is a hub; so there are fewer hubs than the share's inverse
HUB_ROWS, HUB_SHARE = 10_000, 0.001
#: edges that a task joins by itself at a time
EDGES = 200_000


def hub_join(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``values`` (one row a key; n: its rows in ``rows``, of ``total`` in all).

    Hubs, fewer than a thousand, are broadcast, so that no task gets all rows of
    one; the other keys join by shuffle.
    """
    most = max(HUB_ROWS, int(HUB_SHARE * total))
    if total <= most:
        return rows.join(values.drop("n"), key)
    hubs = F.broadcast(values.where(F.col("n") > most))
    rest = rows.join(hubs.select(key), key, "left_anti").join(values.where(F.col("n") <= most), key)
    return rows.join(hubs, key).unionByName(rest).drop("n")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of these edges' components to the least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while ((x := top[a]) != (y := top[b])).any():
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while ((up := top[top]) != top).any():
            top = up
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[below], nodes[top[below]]


def contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the same components; what up to ``EDGES`` rows of a task join hangs under its least node."""
    schema = StructType([StructField(c, edges.schema["u"].dataType) for c in ("u", "v")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            table, kind = pa.Table.from_batches(held), held[0].schema.field(0).type
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x in stars(*(table.column(k).to_numpy() for k in (0, 1)))], ["u", "v"])

        for batch in batches:
            if held and sum(map(len, held)) + len(batch) > EDGES:
                yield made()
            held.append(batch)
        if held:
            yield made()

    return edges.select("u", "v").mapInArrow(run, schema)


def connected(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label): label is the least node of the component; ``links`` has a, b of one type. The result is a stored table.

    Alternating star contraction: each round hangs every node's larger
    neighbours, then its smaller ones, under its least neighbour. Tasks first join
    what they hold by themselves, so that a table of no more edges than a task
    joins at a time needs no round. Rounds grow with the logarithm of the largest
    component; each is written to the shared folder, which cuts the lineage, and
    the one before is removed.
    """

    def summed(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stored(contracted(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), spark, "links")
    sums = summed(edges)
    while sums[0] > EDGES:
        n = sums[0]
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        base = hub_join(both.where("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = base.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hub_join(base, low, "u", 2 * n)
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(contracted(hung), spark, "links")
        forget(edges)
        edges, before, sums = after, sums, summed(after)
        if sums == before:
            break
    else:  # so few that one task joins them all
        after = stored(contracted(edges.coalesce(1)), spark, "links")
        forget(edges)
        edges = after
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out = stored(labels, spark, "labels")
    forget(edges)
    return out
