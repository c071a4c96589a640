"""Filter interaction audit: every order of a set of filters, by a depth-first walk of their permutation trie.

A document's verdict by each filter doesn't depend on the order, so each is found
once: one pass over the texts, then a join that finds copies. Documents alike in
part, verdicts and labels survive alike, and a survivor DataFrame holds one row
for each such class with its number of documents; that is the only time rows of
documents are shuffled. Classes are then dealt out by part (at most 128 of them each),
and nothing in the walk is shuffled again.

Orders that begin with the same letters share a path of the trie, and paths whose
letters are the same set have the same survivors. The walk goes depth first, keeps
the survivor DataFrames of its path persisted, remembers the sets it has met, and
at each set counts what every further filter removes there, in one job that
appends to a table in the shared folder. So 32 sets and 80 edges stand for the
orders of five filters (120 orders, 600 steps). The report looks each step's edge
up by its part; the Shapley value sums an edge's removals times the number of
orders that pass it.

Defined results: null and empty texts count as an empty text (and are copies of
each other); a null part counts as the empty part; a text fails the copy filter
if a smaller doc_id has the same text (SHA-256), a null doc_id being the largest;
rows that repeat share their doc_id, so neither is a copy of the other, and each
is counted; a document with several label rows has a label if any row has it; a
label row without doc_id has no document; an empty table has no parts and so no
rows; long texts take memory in proportion to the longest alone; columns other
than doc_id, text and the part's are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import forget, remove_dir, shared_dir, stored, tidy

#: The characters that filters C and D look for, and bytes that begin no character.
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
INSIDE = bytes(range(0x80, 0xC0))

LETTERS = "ABCDE"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    min_distinct_percent: int = 65
    max_capital_percent: int = 5


def verdicts(data: bytes, rules: Rules) -> int:
    """Bits of the filters that a text fails by itself: A 1, B 2, C 4, D 8."""
    ws = data.split()
    short = len(ws) < rules.min_words
    dull = 100 * len(set(ws)) < rules.min_distinct_percent * len(ws)
    size = len(data) if data.isascii() else len(data.translate(None, INSIDE))
    loud = 100 * (len(data) - len(data.translate(None, CAPITALS))) > rules.max_capital_percent * size
    marked = len(data) != len(data.translate(None, MARKS))
    return short + 2 * dull + 4 * loud + 8 * marked


def judged(docs: DataFrame, part: str, rules: Rules) -> DataFrame:
    """(doc_id, part, fails, text_key): one narrow pass; texts go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([verdicts(t, rules) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                ["doc_id", "part", "fails", "text_key"],
            )

    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, part string, fails int, text_key binary")


def classes(docs: DataFrame, labels: DataFrame, part: str = "source", rules: Rules = Rules()) -> DataFrame:
    """(part, fails, good, toxic, n): documents alike in part, failing filters (bits, E is 16) and labels."""
    rows = stored(judged(docs, part, rules), docs.sparkSession, "audit-rows")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    first = rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copied = F.coalesce((F.col("doc_id").isNull() & F.col("first").isNotNull()) | (F.col("doc_id") > F.col("first")), F.lit(False))
    flagged = rows.join(first, "text_key", "left").select("doc_id", "part", (F.col("fails") + 16 * copied.cast("int")).alias("fails"))
    with_labels = flagged.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    made = stored(with_labels.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n")), docs.sparkSession, "audit-classes")
    forget(rows)
    return made


def walk(root: DataFrame, n_filters: int, path: str) -> int:
    """Depth first over the permutation trie; appends one row for each part, set of filters and next filter to ``path``.

    Returns the number of sets met. At most ``n_filters`` survivor DataFrames are persisted at a time.
    """
    met: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        met.add(state)
        left = [k for k in range(n_filters) if not state >> k & 1]
        if not left:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        edges = survivors.select("part", "n", "good", "toxic", F.explode(F.array(*[F.struct(F.lit(k).alias("filter"), (F.shiftright("fails", k) % 2 == 1).alias("gone")) for k in left])).alias("e"))
        gone = F.when(F.col("e.gone"), F.col("n")).otherwise(0)
        counted = edges.groupBy("part", F.col("e.filter").alias("filter")).agg(
            F.sum("n").alias("before"), F.sum(gone).alias("removed"), F.sum(F.when(F.col("good"), gone).otherwise(0)).alias("good_lost"), F.sum(F.when(F.col("toxic"), gone).otherwise(0)).alias("toxic_lost")
        )
        counted.withColumn("state", F.lit(state)).write.mode("append").parquet(path)
        for k in left:
            if state | 1 << k not in met:
                visit(state | 1 << k, survivors.where(F.shiftright("fails", k) % 2 == 0))
        survivors.unpersist()

    visit(0, root)
    return len(met)


EDGE = "part string, filter int, before long, removed long, good_lost long, toxic_lost long, state int"


def report(edges: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of each step: all steps of all orders for each part, zeros included.

    One shuffle of the edges by part: a part has at most 80 of them for five filters.
    """
    n = len(letters)
    passing = F.lit(0)  # orders that pass an edge from a set of so many filters
    for size in range(n):
        passing = F.when(F.bit_count("state") == size, math.factorial(size) * math.factorial(n - 1 - size)).otherwise(passing)
    of_part = edges.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("state", "filter"), F.struct("before", "removed", "good_lost", "toxic_lost")))).alias("edge"),
        F.array(*[F.sum(F.when(F.col("filter") == k, F.col("removed") * passing).otherwise(0)) for k in range(n)]).alias("shapleys"),
    )
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(letters)])
    steps = of_part.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.array(*map(F.lit, range(1, n + 1)))).alias("step"))
    before = F.expr("left(filter_order, step - 1)")
    state = sum((F.when(before.contains(c), 1 << k).otherwise(0) for k, c in enumerate(letters)), F.lit(0))
    steps = steps.withColumns({"state": state, "filter": F.expr(f"instr('{letters}', substr(filter_order, step, 1)) - 1")})

    def looked_up(of_state: Column, name: str) -> Column:
        return F.coalesce(F.try_element_at("edge", F.struct(of_state.alias("state"), F.col("filter")))[name], F.lit(0).cast("long"))

    here, root, others = F.col("state"), F.lit(0), F.lit((1 << n) - 1) - F.expr("shiftleft(1, filter)")
    return steps.select(
        "part", "filter_order", "step",
        (looked_up(here, "before") - looked_up(here, "removed")).alias("kept"), looked_up(here, "removed").alias("removed"),
        (looked_up(root, "removed") - looked_up(here, "removed")).alias("redundant"), looked_up(others, "removed").alias("unique_fails"),
        looked_up(here, "good_lost").alias("good_lost"), looked_up(here, "toxic_lost").alias("toxic_lost"),
        F.element_at("shapleys", F.col("filter") + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The report of all orders of the five filters over ``docs``."""
    spark = docs.sparkSession
    root = classes(docs, labels, part, rules)
    path = shared_dir(spark, "audit-edges")
    walk(root.repartition("part"), len(LETTERS), path)
    forget(root)
    edges = spark.read.schema(EDGE).parquet(path)
    made = stored(edges.coalesce(8), spark, "audit-report")  # 31 appends are small files
    remove_dir(spark, path)
    return report(made)
