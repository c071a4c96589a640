"""Token-id files: flat unsigned integers plus 64-bit document offsets.

Documents are dealt by ranges of doc_id; each range becomes shards of three
flat files: ``.ids`` (unsigned 16- or 32-bit, by the vocabulary's size),
``.idx`` (64-bit offsets, one more than documents) and ``.doc`` (64-bit ids of
the documents). A task appends to its shard's files as rows arrive and goes on
to a new shard at ``Limits``, so its memory doesn't grow with the range. The
count of ids before a shard, its base, comes from a prefix sum over the shards'
totals; readers map the files into memory, or read them slice by slice, and add
the base.

Defined results: null and empty texts hold the end id alone; a null doc_id is
written first, as the lowest, and read back as null (the id -2**63 is taken for
null); repeated ids and null ids stand beside each other, ordered by a hash of
their text, and are spread over ranges like others; an empty table gives no
shards and no rows; long texts take memory in proportion to the longest alone;
columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import shared_dir, tidy
from casegrid.llm.tokens import word_encoder

NULL_ID = -(2**63)


@dataclass(frozen=True)
class Limits:
    #: ids and documents of a shard, past which the next one begins
    ids: int = 256_000_000
    documents: int = 4_000_000
    #: ids and documents that a reader takes at a time
    slice_ids: int = 4_000_000
    slice_documents: int = 50_000


@dataclass(frozen=True)
class Shard:
    name: str
    n_docs: int
    n_ids: int
    base: int


def open_folder(uri: str):
    """(pyarrow file system, path, local path or None)."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path, parsed.path
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, None


def put(uri: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then rename: a retried task replaces, never tears, a file."""
    system, path, _ = open_folder(uri)
    system.create_dir(path, recursive=True)
    context = TaskContext.get()
    trial = f"{path}/.{name}.{context.taskAttemptId() if context else os.getpid()}"
    with system.open_output_stream(trial) as out:
        out.write(data)
    system.move(trial, f"{path}/{name}")


class Writer:
    """The files of one shard, open under names of this attempt; ``close`` renames them."""

    KINDS = ("ids", "idx", "doc")

    def __init__(self, uri: str, name: str):
        self.system, self.path, _ = open_folder(uri)
        self.system.create_dir(self.path, recursive=True)
        context = TaskContext.get()
        self.name, self.attempt = name, context.taskAttemptId() if context else os.getpid()
        self.out = [self.system.open_output_stream(self._trial(kind)) for kind in self.KINDS]
        self.out[1].write(np.zeros(1, "<i8").tobytes())
        self.n_docs = self.n_ids = 0

    def _trial(self, kind: str) -> str:
        return f"{self.path}/.{self.name}.{kind}.{self.attempt}"

    def add(self, chunks: list[bytes], counts: list[int], docs: list[int]) -> None:
        self.out[0].write(b"".join(chunks))
        self.out[1].write((self.n_ids + np.cumsum(counts)).astype("<i8").tobytes())
        self.out[2].write(np.asarray(docs, "<i8").tobytes())
        self.n_docs += len(docs)
        self.n_ids += sum(counts)

    def close(self) -> None:
        for kind, out in zip(self.KINDS, self.out):
            out.close()
            self.system.move(self._trial(kind), f"{self.path}/{self.name}.{kind}")


class Flat:
    """Part of a flat file as an array: mapped where the file is local, else read at its place."""

    def __init__(self, uri: str, name: str, dtype: str):
        system, path, local = open_folder(uri)
        self.dtype, self.mapped, self.source = np.dtype(dtype), None, None
        if local:
            full = f"{local}/{name}"
            self.mapped = np.memmap(full, dtype=dtype, mode="r") if os.path.getsize(full) else np.empty(0, dtype)
        else:
            self.source = system.open_input_file(f"{path}/{name}")

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[part]
        size = self.dtype.itemsize
        return np.frombuffer(self.source.read_at((part.stop - part.start) * size, part.start * size), self.dtype)


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str, limits: Limits = Limits()) -> list[Shard]:
    """Write ``docs`` (doc_id, text) and the manifest; one shuffle, by range of doc_id.

    Rows of one id are cut by the hash of their text, equal rows by chance, so no
    id fills a range. What the driver gathers is one row a shard.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.rand(17)]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        dtype = "<u2" if encoder.size <= 2**16 else "<u4"
        tail = np.asarray([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        shard: Writer | None = None
        number = 0

        def ended() -> pa.RecordBatch:
            shard.close()
            return pa.RecordBatch.from_arrays([pa.array([shard.name]), pa.array([shard.n_docs], pa.int64()), pa.array([shard.n_ids], pa.int64()), pa.array([dtype])], ["name", "n_docs", "n_ids", "dtype"])

        for batch in batches:
            if not len(batch):
                continue
            if shard is None:
                shard = Writer(folder, f"shard-{part:06d}-{number:06d}")
            chunks, counts = [], []
            for text in batch.column(1):
                got = np.frombuffer(encoder.encode(text.as_py()) + tail, "<u4").astype(dtype)
                chunks.append(got.tobytes())
                counts.append(len(got))
            shard.add(chunks, counts, [NULL_ID if d is None else d for d in batch.column(0).to_pylist()])
            if shard.n_ids >= limits.ids or shard.n_docs >= limits.documents:
                yield ended()
                shard, number = None, number + 1
        if shard is not None:
            yield ended()

    made = sorted(rows.mapInArrow(tidy(run), "name string, n_docs long, n_ids long, dtype string").collect(), key=lambda r: r["name"])
    bases = np.concatenate([[0], np.cumsum([r["n_ids"] for r in made])]).astype(int).tolist()
    shards = [Shard(r["name"], r["n_docs"], r["n_ids"], base) for r, base in zip(made, bases)]
    put(folder, "manifest.json", json.dumps({"dtype": made[0]["dtype"] if made else "<u2", "shards": [vars(s) for s in shards]}).encode())
    return shards


def manifest(folder: str) -> dict:
    system, path, _ = open_folder(folder)
    with system.open_input_file(f"{path}/manifest.json") as source:
        return json.loads(source.read())


def read(spark: SparkSession, folder: str, limits: Limits = Limits()) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    listing = manifest(folder)
    dtype = listing["dtype"]
    shards = [(s["name"], s["n_docs"], s["base"]) for s in listing["shards"]]
    listed = spark.createDataFrame(shards, "name string, n_docs long, base long").repartition(max(1, len(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n_docs, base in zip(*(c.to_pylist() for c in batch.columns)):
                ids, idx, doc = Flat(folder, f"{name}.ids", dtype), Flat(folder, f"{name}.idx", "<i8"), Flat(folder, f"{name}.doc", "<i8")
                for at in range(0, n_docs, limits.slice_documents):
                    edges = np.asarray(idx[at : min(n_docs, at + limits.slice_documents) + 1])
                    low = 0
                    while low < len(edges) - 1:  # documents of so many ids at a time, one at least
                        high = max(low + 1, int(np.searchsorted(edges, edges[low] + limits.slice_ids, side="right")) - 1)
                        inside = edges[low : high + 1]
                        part = ids[int(inside[0]) : int(inside[-1])]
                        own = (inside - inside[0]).tolist()
                        crcs = [zlib.crc32(part[a:b].astype("<u4").tobytes()) for a, b in zip(own[:-1], own[1:])]
                        keys = [None if d == NULL_ID else d for d in doc[at + low : at + high].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(base + inside[:-1]), pa.array(np.diff(inside)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        low = high

    return listed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "token-files")
    write(docs, vocabulary, end_id, folder)
    return read(spark, folder)
