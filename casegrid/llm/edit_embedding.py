"""Document fingerprints from a randomised edit embedding.

A walk shared by all texts reads characters: at clock ``j`` and character ``x``
a random bit, the same for every text, says whether the walk moves on. Texts at
a small edit distance fall into step again after each edit, so their walks show
the same characters at most clocks: edit distance becomes Hamming distance. The
fingerprint samples ``slots`` clocks, consistently over different lengths, and
keeps a few bits of what stands there; bands of sampled slots find candidates,
the likeness of whole fingerprints verifies them.

Defined results: null and empty texts are the empty text and have one common
fingerprint; equal texts have equal fingerprints; null ids order last; repeated
ids are ordered by text; repeated rows follow each other; an empty table gives no
rows; a long text takes memory and steps in proportion to itself; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import forget, free_finished, stored, tidy
from casegrid.llm.components import connected, hub_join

NULL_ID = -(2**63)


@dataclass(frozen=True)
class Settings:
    slots: int = 256
    #: bits kept of a slot
    bits: int = 4
    #: characters from the sampled place on that a slot looks at
    gram: int = 8
    seed: int = 20240229
    #: characters whose walks run side by side
    chunk_chars: int = 6_000_000


class Walk:
    CLOCKS = 128

    def __init__(self, settings: Settings):
        self.settings = settings
        rng = np.random.default_rng(settings.seed)
        bits = rng.random((self.CLOCKS, 256)) < 0.5
        bits[0] = True  # the walk never stands for more than one round
        stay = np.zeros((self.CLOCKS, 256), dtype=np.uint32)
        for j in range(self.CLOCKS):
            for k in range(self.CLOCKS):
                at = bits[(j + k) % self.CLOCKS]
                stay[j] = np.where((stay[j] == 0) & at, k + 1, stay[j])
        self.stay = stay.ravel()  # clocks until the walk leaves a character that it met at clock j
        # consistent sampling: each slot's least random priority among clocks below L, as the sequence of its records
        records = np.zeros((settings.slots, 64))
        for k in range(1, 64):
            records[:, k] = np.floor((records[:, k - 1] + 1) / np.maximum(rng.random(settings.slots), 1e-12))
        self.records = np.minimum(records, 2.0**60).astype(np.int64)
        self.mixers = rng.integers(1, 2**63, size=settings.gram, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def prints(self, texts: list[str]) -> np.ndarray:
        """texts x slots, small integers."""
        s = self.settings
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes[order[0]]) if len(order) else 0
        live = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # texts longer than i
        begin = np.concatenate([[0], np.cumsum(live)])
        flat = np.empty(int(begin[-1]), dtype=np.uint32)
        for rank, k in enumerate(order):
            flat[begin[: sizes[k]] + rank] = (codes[k] ^ (codes[k] >> 8)) & 255
        clocks = np.empty(len(flat), dtype=np.uint32)
        now = np.zeros(len(texts), dtype=np.uint32)
        stay, mask = self.stay, np.uint32(self.CLOCKS - 1)
        edges = begin.tolist()
        for i in range(longest):
            a, b = edges[i], edges[i + 1]
            j = now[: b - a]
            clocks[a:b] = j
            j += stay[((j & mask) << np.uint32(8)) | flat[a:b]]
        out = np.empty((len(texts), s.slots), dtype=np.uint8)
        shift = np.uint64(64 - s.bits)
        steps = np.arange(s.gram)
        for rank, k in enumerate(order):
            n = int(sizes[k])
            met = clocks[begin[:n] + rank]
            sampled = self.records[np.arange(s.slots), (self.records < max(1, int(now[rank]))).sum(axis=1) - 1]
            at = np.maximum(0, np.searchsorted(met, sampled.astype(np.uint32), side="right") - 1) if n else np.zeros(s.slots, dtype=np.int64)
            padded = np.concatenate([codes[k], np.zeros(s.gram, dtype=np.uint32)]).astype(np.uint64) + np.uint64(1)
            gram = padded[at[:, None] + steps]
            with np.errstate(over="ignore"):
                value = ((gram * gram + gram) * self.mixers).sum(axis=1, dtype=np.uint64)
                value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            out[k] = (value >> shift).astype(np.uint8)
        return out

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Share of equal slots, less what chance gives, from 0 to 1."""
        chance = 1.0 / 2**self.settings.bits
        return np.clip(((a == b).mean(axis=-1) - chance) / (1 - chance), 0.0, 1.0)

    def written(self, prints: np.ndarray) -> list[str]:
        return [("%x" * self.settings.slots) % tuple(row) for row in prints.tolist()]


@functools.lru_cache(maxsize=4)
def walk(settings: Settings) -> Walk:
    return Walk(settings)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_descending_ranges(docs: DataFrame) -> DataFrame:
    """bucket, ghost, doc_id, text: partition k holds one range of ids, descending, and last a copy of the row that follows it.

    The range bounds are sampled ids of the table itself, so the row after a
    range is the top row of the next one; it travels twice, every other row
    once. After the lowest range comes the highest id.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"))
    top = key.agg(F.max("k")).first()[0]
    if top is None:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("ghost"), "doc_id", "text")
    inner = docs.select(F.col("doc_id").cast("long").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = np.array(sorted({int(q) for q in inner if q < top}) + [top], dtype=np.int64)
    last = len(bounds) - 1

    @F.pandas_udf("array<int>")
    def places(ids):
        import pandas as pd

        at = np.searchsorted(bounds, ids.to_numpy(dtype=np.int64), side="left")
        edge = bounds[at] == ids.to_numpy(dtype=np.int64)
        return pd.Series([[k, (k + 1) % (last + 1)] if e else [k] for k, e in zip(at.tolist(), edge.tolist())])

    dealt = rows.withColumn("places", places(F.coalesce("doc_id", F.lit(NULL_ID)))).select(F.posexplode("places").alias("copy", "bucket"), "doc_id", "text")
    dealt = dealt.select("bucket", (F.col("copy") > 0).alias("ghost"), "doc_id", "text").repartitionById(last + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def fingerprint_edits(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; one shuffle, by range of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = walk(settings)
        ids: list[int | None] = []
        texts: list[str] = []
        size = 0

        def made(n: int) -> pa.RecordBatch:
            """Rows for the first n texts; text n, the one after them, is at hand."""
            changed = [edited(texts[k], texts[k + 1]) for k in range(n)]
            prints = walker.prints(texts[: n + 1] + changed)
            own, after, other = prints[:n], prints[1 : n + 1], prints[n + 1 :]
            columns = [
                pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array(walker.written(own)), pa.array(walker.written(other)),
                pa.array(walker.likeness(own, other)), pa.array(walker.likeness(own, after)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ended = False
        for batch in batches:
            for ghost, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if ended:
                    continue
                ids.append(doc_id)
                texts.append(text.as_py())
                size += 2 * len(texts[-1]) + 64
                ended = ghost
                if len(texts) > 1 and (ended or size > settings.chunk_chars):
                    yield made(len(texts) - 1)
                    del ids[:-1], texts[:-1]
                    size = 2 * len(texts[0])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_descending_ranges(docs).select("ghost", "doc_id", "text").mapInArrow(tidy(run), schema)


def fingerprints(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, fingerprint: one narrow pass."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = walk(settings)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(walker.written(walker.prints(texts)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, fingerprint string")


def likeness(a: Column, b: Column, settings: Settings = Settings()) -> Column:
    """Likeness of two fingerprint columns."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / 2**settings.bits
    return F.greatest(F.lit(0.0), (same / F.lit(float(settings.slots)) - F.lit(chance)) / F.lit(1 - chance))


#: a bucket of more fingerprints than this is dealt over pairs of parts, of at most so many parts
NEAR_PART, NEAR_PARTS = 2000, 64


def links(codes: np.ndarray, least: float, walker: Walk) -> list[tuple[int, int, float]]:
    """A spanning forest of the fingerprints whose likeness is at least ``least``: what is reached is compared with all that is not reached yet."""
    found = []
    away = np.arange(len(codes))
    reached: list[int] = []
    while len(away):
        if not reached:
            reached, away = [int(away[0])], away[1:]
        at = reached.pop()
        like = walker.likeness(codes[at][None], codes[away])
        near = like >= least
        found += [(at, int(k), float(x)) for k, x in zip(away[near], like[near])]
        reached += away[near].tolist()
        away = away[~near]
    return found


def layout(fingerprints: int, settings: Settings, least: float) -> tuple[int, int]:
    """(bands, slots of a band): so many sampled slots that chance seldom fills a bucket, and so many bands that one of 25 pairs of the least likeness is missed."""
    bits = max(1, fingerprints).bit_length() + 4
    slots = min(settings.slots, max(6, -(-bits // settings.bits)))
    same = (least + (1 - least) / 2**settings.bits) ** slots
    return math.ceil(math.log(0.04) / math.log(1 - same)), slots


def band_slots(settings: Settings, bands: int, slots: int) -> list[list[int]]:
    """The slots whose bits each band samples."""
    rng = np.random.default_rng(settings.seed + 1)
    return [sorted(rng.choice(settings.slots, slots, replace=False).tolist()) for _ in range(bands)]


def _binary(df: DataFrame, name: str) -> Column:
    """A column of hexadecimal text as bytes, half as long; bytes as they are."""
    return F.unhex(name) if dict(df.dtypes)[name] == "string" else F.col(name)


def near_pairs(prints: DataFrame, bands: int | None = None, slots: int | None = None, least: float = 0.75, settings: Settings = Settings()) -> DataFrame:
    """Pairs (a, b, likeness) of at least ``least``, by number, that link the fingerprints which bands of sampled slots find; ``prints``: number, fingerprint, each different, a stored table.

    First numbers alone meet by band; buckets with the same members become one,
    and only their fingerprints travel. Two fingerprints of a bucket are compared
    until they are linked or known to be unlike, so all near pairs of a bucket are
    in one class. The pairs grow with the bucket; the comparisons do so with the
    square of its classes alone, and a large bucket is dealt over pairs of parts.
    """
    total = prints.count()
    n_bands, n_slots = layout(total, settings, least)
    picks = band_slots(settings, bands or n_bands, slots or n_slots)
    prints = prints.select("number", _binary(prints, "fingerprint").alias("code"))
    keys = [F.xxhash64(F.lit(k), *(F.substring("hexed", p + 1, 1) for p in sampled)) for k, sampled in enumerate(picks)]
    placed = prints.select("number", F.hex("code").alias("hexed")).select("number", F.explode(F.array(*keys)).alias("band"))
    sizes = placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.least(F.lit(NEAR_PARTS), F.ceil(F.col("n") / F.lit(NEAR_PART))).cast("int")
    dealt = hub_join(placed, sizes.withColumn("parts", parts), "band", total * len(picks)).withColumn("own", F.pmod(F.xxhash64("number"), F.col("parts")).cast("int"))
    cells = F.expr("transform(sequence(0, parts - 1), k -> struct(least(own, k) as lo, greatest(own, k) as hi))")
    dealt = dealt.select("band", "number", F.explode(cells).alias("cell")).select("band", "cell.lo", "cell.hi", "number")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([x.astype(np.int64) for x in part]) for part in zip(*([c.to_numpy() for c in b.columns] for b in batches))]
        if not columns:
            return
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        band, lo, hi, number = (c[order] for c in columns)
        first = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        found: dict[bytes, bytes] = {}
        for at, end in zip(first.tolist(), np.append(first[1:], len(band)).tolist()):
            members = number[at:end].tobytes()
            found.setdefault(xxhash.xxh3_128_digest(members), members)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["bucket", "members"])

    count = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = dealt.repartition(count, "band", "lo", "hi").mapInArrow(tidy(pack), "bucket binary, members binary")
    buckets = packed.groupBy("bucket").agg(F.first("members").alias("members"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(members)), [len(m) for m in members])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(members) if members else np.empty(0, np.int64))], ["bucket", "number"])

    rows = buckets.mapInArrow(tidy(unpack), "bucket binary, number long").join(prints, "number")

    def compare(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        number = table.column("number").to_numpy()
        two = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(number), -1)
        codes = np.stack([two >> 4, two & 15], axis=2).reshape(len(number), -1)
        a, b, x = list(zip(*links(codes, least, walk(settings)))) or ((), (), ())
        pair = np.sort(number[np.array([a, b], np.int64)], axis=0)
        return pa.table([pa.array(pair[0]), pa.array(pair[1]), pa.array(x, pa.float64())], ["a", "b", "likeness"])

    found = rows.select("bucket", "number", "code").groupBy("bucket").applyInArrow(compare, "a long, b long, likeness double")
    return found.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def with_near_class(rows: DataFrame, id_column: str, settings: Settings = Settings()) -> DataFrame:
    """``rows`` (with ``fingerprint``) and near_class: the least id among the rows whose fingerprints banding and verification link with the row's own.

    Rows are written once, hexadecimal columns as bytes, and join their class by fingerprint.
    """
    spark = rows.sparkSession
    hexed = [c for c in ("fingerprint", "edited_fingerprint", "edited_sha256") if c in rows.columns]
    rows = stored(rows.select(*[_binary(rows, c).alias(c) if c in hexed else F.col(c) for c in rows.columns]), spark, "prints")
    free_finished(spark)
    kinds = rows.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(id_column).alias("least"))
    kinds = stored(kinds.withColumn("number", F.monotonically_increasing_id()), spark, "kinds")
    free_finished(spark)
    pairs = stored(near_pairs(kinds, settings=settings), spark, "near-prints")
    free_finished(spark)
    labels = connected(spark, pairs)
    labelled = kinds.join(labels.withColumnRenamed("node", "number"), "number", "left").withColumn("label", F.coalesce("label", "number"))
    least = labelled.groupBy("label").agg(F.min("least").alias("near_class"))
    named = stored(labelled.select("fingerprint", "n", "label").join(least, "label").drop("label"), spark, "near-classes")
    forget(kinds, pairs, labels)
    free_finished(spark)
    joined = hub_join(rows, named, "fingerprint", rows.count())
    return joined.select(*[F.lower(F.hex(c)).alias(c) if c in hexed else F.col(c) for c in joined.columns])
