"""Best-fit packing of documents into training sequences.

A document becomes its token ids and an end id, cut into pieces only where it
exceeds the sequence length. Pieces, longest first, go to the open sequence
that fits best as a vector of three demands (tokens, documents, attention
cost = length squared): the one that leaves the smallest weighted norm of
residual capacity, or has the largest weighted dot product of demand and
residual, among those that violate no capacity.

Packing goes by levels. Each input partition packs its own pieces without a
shuffle; sequences that stay under-filled are then opened again and packed
together, ``regroup`` partitions at a time, and those that still are, ``regroup``
of these groups at a time, until one group is left. Each level leaves a small
share of its sequences to the next.

At their defaults the capacities for documents (a piece has a token at least) and
for attention cost can't bind in sequences of 2,048 tokens, so as few sequences are
made as tokens allow; with lower ones they do.

Defined results: null and empty texts are one piece of the end id alone; a null
doc_id is kept; repeated rows are packed as often as they occur; pieces of one
length go in order of their rows; an empty table gives no rows; a long text is
cut into pieces and takes memory in proportion to itself alone; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import stored, tidy
from casegrid.llm.tokens import word_encoder


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: weights of the three demands
    weights: tuple[float, float, float] = (1.0, 0.05, 0.01)
    rule: str = "norm"  # or "dot"
    #: a sequence filled less than this is opened again in the next level
    refill_below: float = 0.98
    #: partitions, then groups, whose rest is packed together
    regroup: int = 64


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, offset in it); longest first, ties in input order."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weight = np.array(capacity.weights)
    left = np.empty((3, 1024))
    number = np.empty(1024, dtype=np.int64)
    n_open = made = 0
    smallest = lengths.min(initial=capacity.tokens)
    for k in order:
        size = int(lengths[k])
        need = np.array([size, 1.0, float(size) * size])
        rest = left[:, :n_open]
        fits = np.flatnonzero((rest[0] >= need[0]) & (rest[1] >= need[1]) & (rest[2] >= need[2])) if n_open else []
        if len(fits):
            if capacity.rule == "dot":
                value = (weight * need / full**2) @ rest[:, fits]
                at = fits[np.argmax(value)]
            else:
                after = (rest[:, fits] - need[:, None]) / full[:, None]
                at = fits[np.argmin(weight @ (after * after))]
        else:
            if n_open == left.shape[1]:
                left, number = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([number, np.empty_like(number)])
            at = n_open
            left[:, at], number[at] = full, made
            n_open, made = n_open + 1, made + 1
        bins[k] = number[at]
        offsets[k] = capacity.tokens - int(left[0, at])
        left[:, at] -= need
        if left[0, at] < smallest or left[1, at] < 1:  # closed: the last open one takes its place
            n_open -= 1
            left[:, at], number[at] = left[:, n_open], number[n_open]
    return bins, offsets


SCHEMA = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: Capacity, remember: int) -> DataFrame:
    """First level: every input partition cuts and packs its own documents."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary, remember)
        tail = np.asarray([end_id], "<u4").tobytes()
        step = 4 * capacity.tokens
        ids, rows, piece, start, length, crc = [], [], [], [], [], []
        n = 0
        for batch in batches:
            ids.append(batch.column(0))
            for text in batch.column(1):
                data = encoder.encode(text.as_py()) + tail
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    rows.append(n)
                    piece.append(at // step)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                n += 1
        if not n:
            return
        sizes = np.asarray(length, dtype=np.int64)
        bins, offsets = best_fit(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        base = TaskContext.get().partitionId() << 33
        doc = pa.chunked_array(ids).combine_chunks().take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(base + bins), pa.array(offsets), pa.array(fill)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"],
        )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA.format(kind=kind))


def refill(rest: DataFrame, capacity: Capacity, width: int, number: int) -> DataFrame:
    """A further level: pack again the pieces of under-filled sequences, ``width`` partitions at a time."""
    kind = dict(rest.dtypes)["doc_id"]

    def run(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        sizes = table.column("length").to_numpy().astype(np.int64)
        old = table.column("sequence_id").to_numpy()
        bins, offsets = best_fit(sizes, capacity)
        # numbers of sequences that are opened here are free again; a group has no more new ones than old ones
        free = np.unique(old)
        more = ((int(old.min()) >> 33) << 33) + 2**32 + number * 2**26 + np.arange(max(0, bins.max(initial=-1) + 1 - len(free)))
        fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.Table.from_arrays([*(table.column(c) for c in names), pa.array(np.concatenate([free, more])[bins]), pa.array(offsets), pa.array(fill)], [*names, "sequence_id", "offset", "fill"])

    grouped = rest.withColumn("part", F.floor(F.shiftright("sequence_id", 33) / F.lit(width)).cast("long"))
    return grouped.groupBy("part").applyInArrow(run, SCHEMA.format(kind=kind))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: Capacity = Capacity(), remember: int = 700_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece.

    The first level is written once to the shared folder, so the tokenizing is
    done once and a lost executor costs a re-read; so is each further level but
    the last, whose input is small.
    """
    spark = docs.sparkSession
    level = stored(cut(docs, vocabulary, end_id, capacity, remember), spark, "packing")
    under = F.col("fill") < int(capacity.refill_below * capacity.tokens)
    last = level.agg(F.max(F.shiftright("sequence_id", 33))).first()[0]
    out = level.where(~under)
    width, number = capacity.regroup, 0
    while last is not None:
        level, number = refill(level.where(under), capacity, width, number), number + 1
        if width > last:  # one group
            return out.unionByName(level).drop("fill")
        level = stored(level, spark, "packing")
        out = out.unionByName(level.where(~under))
        width *= capacity.regroup
    return out.drop("fill")
