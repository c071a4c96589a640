"""Exact n-gram Jaccard join by universe partition and the pigeonhole.

Sets of hashed word n-grams are compared in size bands. In a band the universe
of hashes is cut into segments; two linked sets differ in at most H hashes, so
some segment differs by less than its allocation if the allocations add up to
H + 1. Each band is laid out by the cost estimated from its number of sets:

* allocation one: m = H + 1 + slack segments, one signature (the sum of its
  hashes) for each. A set of a given size has at least m less its own most
  differences of them in common with a linked one, so weak signatures (of empty
  segments, and of hashes that a sample shows to be frequent) get allocation
  nought and are left out, as long as the set has fewer of them than that; a set
  with more keeps all. This loses no pair, and tells how many signatures a set
  must share with others to have a link at all.
* allocation two: half as many segments, and for each the signatures of the
  whole segment and of its one-deletion neighbourhood, which are equal if the
  segments differ by at most one hash. Short sets, whose segments would often
  be empty, take this one.

Signatures travel packed by bucket. In a group of equal signatures each set
meets the group's first and its own predecessor; candidates pass a lower bound
of their difference (parity sketches) and are verified exactly on their texts.
Groups of four or more whose members are still in different components are
compared by sketches, in blocks, large groups over several tasks, once; of the
pairs that the sketches allow a spanning forest of each group leaves the task.
What these forests connect, whatever groups it came from, is a cluster, of which
each set is a member once; all pairs of a cluster in different components are
verified exactly where their texts are met, large clusters over several tasks,
and links that join components leave. So memberships of groups are read once and
no pair is written, tested or not; only the component is asked for, so pairs
inside one are never expanded.

Defined results: a text with fewer words than n is one shingle of all its words;
null texts, empty texts and texts without words have the empty set, link with
nothing and are components of their own; equal sets are one class and are
compared once; repeated rows are in one component; null ids never become a
component's number unless all are null; an empty table gives no rows; long texts
take memory in proportion to the longest alone; other columns don't matter,
whatever their names. Shingles and sets are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from casegrid.llm.common import CARRIED, carry, drawn, forget, free_finished, refuse_empty, stored, tidy
from casegrid.llm.components import connected, hub_join, stars


@dataclass(frozen=True)
class Settings:
    n: int = 5
    percent: int = 75
    #: share of H + 1 that the slack has
    slack: float = 0.15
    #: documents whose shingles are counted to find frequent ones: a bound on cost, not on results
    sample: int = 8000
    #: frequent shingles that are broadcast at most
    frequent: int = 300_000
    #: members of a group that are compared with all others at a time, and 64-bit words of sketches that are compared at a time
    block: int = 256
    cells: int = 4_000_000
    #: members of a part of a group, and parts of a group at most; pairs of parts are dealt to tasks
    part: int = 2000
    parts: int = 64
    #: shingles of a part of a cluster (about as many as the cluster's texts have, and 8 bytes each); more parts are made where it takes them
    part_shingles: int = 1_000_000
    #: pairs of numbers (16 bytes each) that are broadcast at most
    small: int = 1_000_000
    #: bytes of a text that is broadcast when more than a hundredth of all pairs have it
    hub_bytes: int = 1_000_000


class WordNumbers(dict):
    """Numbers words as they are first asked for; ``values`` has the hash of each."""

    def __init__(self) -> None:
        super().__init__()
        self.values = np.empty(1 << 16, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        if k == len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        self.values[k] = xxhash.xxh64_intdigest(word)
        return k


class Shingler:
    """Texts as shingle hashes; a word is hashed once and then known by its number."""

    #: words remembered at most
    LIMIT = 250_000

    def __init__(self, n: int):
        self.n = n
        self.known = WordNumbers()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the n-grams."""
        ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not ws:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > self.LIMIT:
            self.known = WordNumbers()
        codes = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
        h = self.known.values[codes]
        width = min(self.n, len(h))
        m = len(h) - width + 1
        with np.errstate(over="ignore"):
            out = np.full(m, 0x2545F4914F6CDD1D + width, dtype=np.uint64)
            for k in range(width):
                out ^= h[k : k + m]
                out *= np.uint64(0xFF51AFD7ED558CCD)
                out ^= out >> np.uint64(32)
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out.sort()
        new = np.empty(m, dtype=bool)
        new[0] = True
        np.not_equal(out[1:], out[:-1], out=new[1:])
        return out[new]


def signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def class_key(shingles: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(shingles.tobytes()))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Bands:
    """Size bands (tops grow by 100 / percent) and the segments of each.

    ``sets``: sets of each band, from which the cheaper allocation is chosen.
    """

    def __init__(self, s: Settings, sets: dict[int, int]):
        self.s = s
        self.sets = sets
        self.tops = [0, 1]
        self.made: dict[int, tuple[bool, int, np.ndarray]] = {}

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(self.tops[-1] * 100 // self.s.percent + 1)
        return int(np.searchsorted(self.tops, size))

    def reaches_next(self, size: int, band: int) -> bool:
        """Can a set of this size link with the smallest of the next band?"""
        return 100 * size >= self.s.percent * (self.tops[band] + 1)

    def layout(self, band: int) -> tuple[bool, int, np.ndarray]:
        """(allocation two?, slack, hashes that begin the segments)."""
        if band not in self.made:
            while len(self.tops) <= band:
                self.tops.append(self.tops[-1] * 100 // self.s.percent + 1)
            t, top = self.s.percent, self.tops[band]
            most = 2 * top * (100 - t) // (100 + t)  # differences of a linked pair
            slack = int(self.s.slack * (most + 1))
            one, two = most + 1 + slack, most // 2 + 1
            deletions = self.cost_two(band, top, two) < self.cost_one(band, top, one, slack)
            m = two if deletions else one
            self.made[band] = deletions, slack, np.array([(k * 2**64) // m for k in range(m)], dtype=np.uint64)
        return self.made[band]

    def most_apart(self, size: int, band: int) -> int:
        """Most differences between a set of this size and any that it links with in the band."""
        t = self.s.percent
        return (size + min(self.tops[band], size * 100 // t)) * (100 - t) // (100 + t)

    def cost_one(self, band: int, top: int, m: int, slack: int) -> float:
        """Signatures and chance pairs if empty segments go as far as the slack allows."""
        n, empty = self.sets.get(band, 1), float(np.exp(-top / m))
        mean, term, over = m * empty, float(np.exp(-m * empty)), 1.0
        for k in range(slack + 1):
            over -= term
            term *= mean / (k + 1)
        return n * m + m * (n * max(0.0, over) * empty) ** 2 / 2

    def cost_two(self, band: int, top: int, m: int) -> float:
        n, mean = self.sets.get(band, 1), top / m
        empty = float(np.exp(-mean))
        return n * (m + top) + m * (n * empty) ** 2 * (0.5 + mean + mean * mean / 2)


def frequent_sums(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray | None:
    """Prefix counts of the shingles that are frequent; None if there are none."""
    if not len(frequent):
        return None
    there = frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
    return np.concatenate([[0], np.cumsum(there)]) if there.any() else None


def signatures(shingles: np.ndarray, band: int, bands: Bands, often: np.ndarray | None) -> tuple[np.ndarray, int]:
    """(signatures, how many of them at least any linked set of the band shares)."""
    deletions, _, edges = bands.layout(band)
    begin = np.searchsorted(shingles, edges)
    ends = np.append(begin[1:], len(shingles))
    with np.errstate(over="ignore"):
        mixed = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        sig = sums[ends] - sums[begin]
        salt = edges ^ np.uint64(band * 0x9E3779B1)
        if deletions:
            own = np.repeat(np.arange(len(edges)), ends - begin)
            sig, salt = np.concatenate([sig, sig[own] - mixed]), np.concatenate([salt, salt[own]])
        sig = (sig ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
        sig ^= sig >> np.uint64(33)
    if deletions:
        return np.unique(sig), 1
    weak = begin == ends
    if often is not None:
        weak |= often[ends] - often[begin] == ends - begin
    # a linked set differs from one of this size in so many hashes at most; it has equal segments at least where those don't fall
    equal = len(edges) - bands.most_apart(len(shingles), band)
    n_weak = int(weak.sum())
    return (sig[~weak], equal - n_weak) if n_weak < equal else (sig, 1)  # the other set may leave out more


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits: two sets differ in at least as many hashes as sketches in bits."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    got = np.frombuffer(data, np.uint8)
    while len(got) > size:
        got = got[: len(got) // 2] ^ got[len(got) // 2 :]
    return got


def may_link(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return (100 + percent) * apart <= (100 - percent) * (na + nb)


@dataclass
class Sample:
    """What a bounded sample of different texts tells; it steers cost, not results."""

    frequent: np.ndarray  # hashes of frequent shingles, sorted
    sets: dict[int, int]  # sets of each size band, scaled to all documents


def drawn_sample(docs: DataFrame, s: Settings) -> Sample:
    """Shingles in two hundredths of a percent of the sample, three documents at least, the most frequent first; and sets by band."""
    total = docs.count()
    if not total:
        return Sample(np.empty(0, np.uint64), {})
    share = min(1.0, s.sample / total)
    texts = docs.select("text").where(drawn("text", share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(s.n), Bands(s, {})
        for batch in batches:
            sets = [shingler(t.as_py()) for t in batch.column(0)]
            if sets:
                value, times = np.unique(np.concatenate(sets), return_counts=True)
                band, n = np.unique([bands.band(len(x)) for x in sets if len(x)] or [0], return_counts=True)
                kind = np.repeat(np.array([0, 1], np.int32), [len(value), len(band)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([value.view(np.int64), band.astype(np.int64)])), pa.array(np.concatenate([times, n]))], ["kind", "h", "n"])

    counted = stored(texts.mapInArrow(tidy(run), "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")), docs.sparkSession, "jaccard-sample")
    often = counted.where("kind = 0").where(F.col("n") >= max(3, int(0.0002 * share * total)))
    got = often.orderBy(F.desc("n"), "h").limit(s.frequent).select("h").toArrow().column("h").to_numpy()
    sets = {r["h"]: int(r["n"] / share) for r in counted.where("kind = 1").collect()}
    refuse_empty(len(sets), share, "documents")
    forget(counted)
    return Sample(np.sort(got.astype(np.int64).view(np.uint64)), sets)


KEEP = 40  # bits of a signature inside its bucket
HEAD = 12  # bytes of a record before its signatures
MANY = 2**15 - 1  # signatures of one record; a set with more in a bucket has several records there


def described(docs: DataFrame, s: Settings, buckets: int, sample: Sample) -> DataFrame:
    """One pass over the texts, with two kinds of rows.

    Of each document (bucket null): doc_id, text_key, n_shingles, key (null for
    the empty set), sketch; sketches stand with the first of equal sets in a task.
    And bucket, data: the signatures of a task's different sets by bucket. A
    record in ``data`` is a set: key (8 bytes), then 16-bit words for the
    signatures here with the own-band flag, and for how many a linked set shares
    at least over all buckets (65,535 where it is more: a lower bound loses no pair);
    then 40 bits of each signature.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    id_type = docs.schema["doc_id"].dataType
    names = ["doc_id", "text_key", "n_shingles", "key", "sketch", "bucket", "data"]
    schema = StructType([StructField("doc_id", id_type), *StructType.fromDDL("text_key long, n_shingles long, key long, sketch binary, bucket int, data binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands, often = Shingler(s.n), Bands(s, shared.value.sets), shared.value.frequent
        met: set[int] = set()
        keys, counts, least, sigs = [], [], [], []
        held = 0

        def made(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal held
            sig = np.concatenate(sigs)
            owner = np.repeat(np.arange(len(keys)), np.array(counts) >> 1)
            bucket = ((sig >> np.uint64(KEEP)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 2**16 else bucket, kind="stable")  # owners stay in order
            sig, owner, bucket = sig[order] & np.uint64(2**KEEP - 1), owner[order], bucket[order]
            begins = np.concatenate([[True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1])])
            at = np.arange(len(sig))
            begins |= (at - np.maximum.accumulate(np.where(begins, at, 0))) % MANY == 0
            first = np.flatnonzero(begins)
            size = np.diff(np.append(first, len(sig)))
            head = np.zeros((len(first), HEAD), np.uint8)
            head[:, :8] = np.array(keys, np.int64)[owner[first]].astype("<i8").view(np.uint8).reshape(-1, 8)
            head[:, 8:10] = ((size << 1) | (np.array(counts)[owner[first]] & 1)).astype("<u2").view(np.uint8).reshape(-1, 2)
            head[:, 10:] = np.minimum(np.array(least)[owner[first]], 2**16 - 1).astype("<u2").view(np.uint8).reshape(-1, 2)
            body = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEEP // 8]
            cut = np.flatnonzero(np.concatenate([[True], bucket[first][1:] != bucket[first][:-1]]))
            ends = np.append(cut[1:], len(first))
            sums = np.concatenate([[0], np.cumsum(size)])
            data = []
            for a, b in zip(cut.tolist(), ends.tolist()):
                data.append(np.array([b - a], "<u4").tobytes() + head[a:b].tobytes() + body[sums[a] : sums[b]].tobytes())
            n = len(data)
            empty = [pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            out = pa.RecordBatch.from_arrays([*empty, pa.array(bucket[first][cut].astype(np.int32)), pa.array(data, pa.binary())], names)
            keys.clear(), counts.clear(), least.clear(), sigs.clear()
            held = 0
            return out

        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            sizes, own_keys, sketches = [], [], []
            for text in batch.column(2):
                got = shingler(text.as_py())
                key = class_key(got) if len(got) else None
                sizes.append(len(got))
                own_keys.append(key)
                if key is None or key in met:
                    sketches.append(None)
                    continue
                sketches.append(sketch(got))
                met.add(key)
                band = bands.band(len(got))
                sums = frequent_sums(got, often)
                for level, own in ((band, 1), (band + 1, 0)) if bands.reaches_next(len(got), band) else ((band, 1),):
                    sig, shared_by = signatures(got, level, bands, sums)
                    keys.append(key)
                    least.append(shared_by)
                    counts.append(len(sig) << 1 | own)
                    sigs.append(sig)
                    held += len(sig)
                if held > 500_000:
                    yield made(kind)
            n = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(own_keys, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if keys and held:
            yield made(kind)

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(tidy(run), schema)


def unpacked(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(signature, key, own, least) of all records."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    step = KEEP // 8
    for blob in blobs:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        head = np.frombuffer(blob, np.uint8, HEAD * n, 4).reshape(n, HEAD)
        key = np.ascontiguousarray(head[:, :8]).view("<i8").ravel()
        count = np.ascontiguousarray(head[:, 8:10]).view("<u2").ravel()
        least = np.ascontiguousarray(head[:, 10:]).view("<u2").ravel().astype(np.uint32)
        size = count >> 1
        body = np.frombuffer(blob, np.uint8, offset=4 + HEAD * n).reshape(-1, step)
        wide = np.zeros((len(body), 8), np.uint8)
        wide[:, :step] = body
        for k, column in enumerate((wide.view("<u8").ravel(), np.repeat(key, size), np.repeat((count & 1).astype(bool), size), np.repeat(least, size))):
            out[k].append(column)
    return tuple(np.concatenate(columns) for columns in out)


def groups_of(both: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """The rows of documents as they came (kind null), and rows of three kinds: 0, candidate pairs (a, b) with n signatures; 1, members b of the groups a of four or more
    (a: a hash of all members, so that equal memberships are one group whichever tasks found them);
    2, sets a with n signatures in groups of two or more, of b // 2 that a linked set shares at least (b odd: own band)."""

    of_documents = StructType([f for f in both.schema.fields if f.name not in ("bucket", "data")])
    own, names = len(of_documents), [*of_documents.names, "kind", "a", "b", "n"]
    kinds: list[pa.DataType] = []

    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(a), x) for x in kinds), pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (a, b, n))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for b in batches:
            kinds[:] = [b.column(k).type for k in range(own)]
            here = b.column(own).is_valid()
            blobs += b.column(own + 1).filter(here).to_pylist()
            rest = b.filter(b.column(own).is_null())
            if len(rest):
                yield pa.RecordBatch.from_arrays([*rest.columns[:own], pa.nulls(len(rest), pa.int32()), *(pa.nulls(len(rest), pa.int64()) for _ in range(3))], names)
        if not blobs:
            return
        sig, member, of_band, least = unpacked(blobs)
        blobs.clear()
        order = np.argsort(sig)
        ranked = sig[order]
        again = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
        order = order[again[1:] | again[:-1]]  # most signatures occur once
        if not len(order):
            return
        order = order[np.lexsort((member[order], sig[order]))]
        sig, member, of_band, least = sig[order], member[order], of_band[order], least[order]
        # a set met in several tasks is one member; it is its own band's if any record says so
        first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])]))
        of_band = np.add.reduceat(of_band, first) > 0
        sig, member, least = sig[first], member[first], least[first]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(start, len(sig)))
        good = (size > 1) & (np.add.reduceat(of_band, start) > 0)
        group = np.repeat(np.arange(len(start)), size)
        inside = np.flatnonzero(good[group])
        if not len(inside):
            return
        asked, n = np.unique(np.stack([member[inside], 2 * least[inside].astype(np.int64) + of_band[inside]], axis=1), axis=0, return_counts=True)
        yield rows(2, asked[:, 0], asked[:, 1], n)
        at = inside[inside != start[group[inside]]]
        pairs, n = np.unique(np.stack([np.concatenate([member[start[group[at]]], member[at - 1]]), np.concatenate([member[at], member[at]])], axis=1), axis=0, return_counts=True)
        yield rows(0, pairs[:, 0], pairs[:, 1], n)
        seen: set[int] = set()
        keep, marks = [], []
        for k in np.flatnonzero(good & (size > 3)).tolist():  # equal memberships are kept once
            mark = signed(xxhash.xxh3_64_intdigest(member[start[k] : start[k] + size[k]].tobytes()))  # groups of one hash would be one larger group: no pair is lost
            if mark not in seen:
                seen.add(mark)
                keep.append(k)
                marks.append(mark)
        if keep:
            chosen = np.array(keep, dtype=np.int64)
            of = size[chosen]
            place = np.repeat(start[chosen] - (np.cumsum(of) - of), of) + np.arange(of.sum())
            yield rows(1, np.repeat(np.array(marks, dtype=np.int64), of), member[place], np.ones(len(place)))

    dealt = both.repartitionById(buckets, F.coalesce("bucket", F.pmod(F.hash("doc_id", "text_key"), F.lit(buckets))).cast("int"))
    return dealt.mapInArrow(tidy(run), StructType([*of_documents.fields, *StructType.fromDDL("kind int, a long, b long, n long").fields]))


def able(found: DataFrame) -> DataFrame:
    """key of the sets that share enough signatures with others to have a link at all."""
    shared = found.where("kind = 2").groupBy("a", F.expr("b % 2").alias("own")).agg(F.sum("n").alias("n"), F.max(F.expr("b div 2")).alias("least"))
    return shared.where("n >= least").select(F.col("a").alias("key")).distinct()


def sketched(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b, n) that the sketches don't rule out."""
    one = classes.select(F.col("key").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    two = classes.select(F.col("key").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (3, 4, 5, 6)]
            yield batch.select([0, 1, 2]).filter(pa.array([may_link(a, b, na, nb, s.percent) for a, na, b, nb in zip(*cols)], pa.bool_()))

    near = pairs.join(one, "a").join(two, "b").where((100 * F.least("na", "nb") >= s.percent * F.greatest("na", "nb")))
    return near.select("a", "b", "n", "sa", "na", "sb", "nb").mapInArrow(tidy(run), "a long, b long, n long")


def verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose shingle sets link, from ``texts`` (key, text).

    A text that more than a hundredth of the pairs have (fewer than a hundred
    texts, of a bounded size) is broadcast instead of meeting its pairs in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.n)
        last, hub = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, hub = a, shingler(ta.as_py())
                keep.append(linked(hub, shingler(tb.as_py()), s.percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    total = pairs.count()
    numbers = pairs.select("a", "b")
    with_b = texts.select(F.col("key").alias("b"), F.col("text").alias("tb")).join(F.broadcast(numbers) if total <= s.small else numbers, "b").select("a", "b", "tb")
    of_a = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    if total <= s.small:
        of_a = of_a.join(F.broadcast(numbers.select("a").distinct()), "a", "left_semi")
    often = [r["a"] for r in pairs.groupBy("a").count().where(F.col("count") > max(100, total // 100)).collect()]  # fewer than a hundred keys
    if not often:
        both = with_b.join(of_a, "a")
    else:
        hub = F.col("a").isin(often)
        short = of_a.where(hub & (F.octet_length("ta") <= s.hub_bytes))
        beyond = with_b.where(~hub).unionByName(with_b.where(hub).join(F.broadcast(short.select("a")), "a", "left_anti"))
        both = with_b.where(hub).join(F.broadcast(short), "a").unionByName(beyond.join(of_a, "a"))
    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def in_cells(members: DataFrame, s: Settings, part: int) -> DataFrame:
    """``members`` (group, key, label, ...) of groups with several labels, with own, lo, hi: large groups are cut into parts, and every pair of parts is a cell.

    ``own`` is a member's part; the cell of two members' parts compares them. Parts are bounded in shingles, too, if ``members`` has n_shingles.
    """
    shingles = F.sum("n_shingles") if "n_shingles" in members.columns else F.lit(0)
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), shingles.alias("shingles"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
    parts = F.greatest(F.least(F.lit(s.parts), F.ceil(F.col("n") / F.lit(part))), F.ceil(F.col("shingles") / F.lit(s.part_shingles)))
    sizes = sizes.select("group", "n", parts.cast("int").alias("parts"))
    placed = members.join(F.broadcast(sizes.drop("n")), "group") if sizes.count() <= s.small else hub_join(members, sizes, "group", members.count())
    placed = placed.withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    cells = F.expr("transform(sequence(0, parts - 1), k -> struct(least(own, k) as lo, greatest(own, k) as hi))")
    return placed.withColumn("cell", F.explode(cells)).withColumn("lo", F.col("cell.lo")).withColumn("hi", F.col("cell.hi")).drop("cell", "parts")


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """Each cell of rows in order of group, lo, hi (the first columns), and whether it is a pair of parts."""
    rest: pa.Table | None = None
    for batch in _with_end(batches):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
        if rest is None or not len(rest):
            continue
        cell = np.stack([rest.column(k).to_numpy().astype(np.int64) for k in range(3)])
        edge = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)]))
        ends = np.append(edge[1:], len(rest)).tolist()
        done = len(edge) if batch is None else len(edge) - 1
        for at, end in zip(edge[:done].tolist(), ends[:done]):
            if end - at > 1:
                yield bool(cell[1, at] != cell[2, at]), rest.slice(at, end - at)
        rest = rest.slice(int(edge[done])) if done < len(edge) else None


def allowed(n: np.ndarray, sketches: list[bytes], own: np.ndarray, crossed: bool, apart: list[np.ndarray], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions, ordered by the first, whose sizes and sketches allow a link and that differ in all of ``apart``, whose arrays the caller may change between blocks.

    Pairs of different parts where ``crossed``, else all pairs.
    """
    width = min(map(len, sketches))
    bits = np.stack([folded(x, width) for x in sketches]).view(np.uint64)
    one, two = (np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())) if crossed else (np.arange(len(n)),) * 2
    step = max(1, min(s.block, s.cells // (max(1, len(two)) * bits.shape[1])))
    most = max(1, s.cells // (16 * bits.shape[1]))  # few MB at a time: an executor has several workers
    for lo in range(0, len(one), step):
        a, b = one[lo : lo + step], two if crossed else two[lo:]
        fit = 100 * np.minimum(n[a][:, None], n[b]) >= s.percent * np.maximum(n[a][:, None], n[b])
        for x in apart:
            fit &= x[a][:, None] != x[b]
        i, j = np.nonzero(fit if crossed else np.triu(fit, 1))
        i, j = a[i], b[j]
        near = np.zeros(len(i), bool)
        for at in range(0, len(i), most):
            x, y = i[at : at + most], j[at : at + most]
            differ = bits[x]
            differ ^= bits[y]
            near[at : at + most] = (100 + s.percent) * np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= (100 - s.percent) * (n[x] + n[y])
        if near.any():
            yield i[near], j[near]


def near_forests(members: DataFrame, s: Settings, parts: int) -> DataFrame:
    """(a, b): of each cell a spanning forest of the pairs in different components whose sizes and sketches allow a link; fewer than its members.

    ``members``: group, lo, hi, own, key, label, n_shingles, sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for crossed, rows in cells_of(batches):
            own, keys, labels, n = (rows.column(k).to_numpy() for k in ("own", "key", "label", "n_shingles"))
            of = np.arange(len(keys))
            for i, j in allowed(n, rows.column("sketch").to_pylist(), own, crossed, [labels, of], s):
                x, y = stars(of[i], of[j])
                to = np.arange(len(keys))
                to[x] = y
                of[:] = to[of]
                yield pa.RecordBatch.from_arrays([pa.array(keys[x]), pa.array(keys[y])], ["a", "b"])

    rows = members.select("group", "lo", "hi", "own", "key", "label", "n_shingles", "sketch")
    return rows.repartition(parts, "group", "lo", "hi").sortWithinPartitions("group", "lo", "hi").mapInArrow(tidy(run), "a long, b long")


def links_in_cells(members: DataFrame, s: Settings, parts: int) -> DataFrame:
    """(a, b): links that join the components of a cell's members, all pairs of different components being verified exactly.

    ``members``: group, lo, hi, own, key, label, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(s.n)
        for crossed, rows in cells_of(batches):
            own, keys, labels = (rows.column(k).to_numpy() for k in ("own", "key", "label"))
            sets = [shingler(text.as_py()) for text in rows.column("text")]
            n, sketches = np.array(list(map(len, sets))), list(map(sketch, sets))
            values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            there, labels = np.zeros(len(values), bool), labels.copy()
            sets = np.split(numbers.astype(np.int32), np.cumsum(n)[:-1])
            del values, numbers
            for i, j in allowed(n, sketches, own, crossed, [labels], s):
                first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                for a, others in zip(i[first].tolist(), np.split(j, first[1:])):
                    there[sets[a]] = True
                    others = others[labels[others] != labels[a]]
                    for chunk in np.split(others, np.flatnonzero(np.diff(np.cumsum(n[others]) // (s.cells // 16))) + 1):
                        chunk = chunk[labels[chunk] != labels[a]]
                        if not len(chunk):
                            continue
                        begin = np.cumsum(n[chunk]) - n[chunk]
                        both = np.add.reduceat(there[np.concatenate([sets[b] for b in chunk.tolist()])], begin, dtype=np.int64)
                        met = chunk[100 * both >= s.percent * (n[a] + n[chunk] - both)]
                        if len(met):
                            old, at = np.unique(labels[met], return_index=True)
                            labels[np.isin(labels, old)] = labels[a]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), keys[a])), pa.array(keys[met[at]])], ["a", "b"])
                    there[sets[a]] = False

    rows = members.select("group", "lo", "hi", "own", "key", "label", "text")
    return rows.repartition(parts, "group", "lo", "hi").sortWithinPartitions("group", "lo", "hi").mapInArrow(tidy(run), "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def text_key(text: str = "text"):
    """A 64-bit hash of the text, by which rows and classes find texts again: ids may repeat or be null."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def components(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, key (null for the empty set), text_key of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a task unpacks all signatures of its bucket
    # signatures go from the texts to their buckets without being stored on the way
    both = stored(groups_of(described(docs, s, buckets, drawn_sample(docs, s)), s, buckets), spark, "jaccard-groups", block_size=16 << 20)
    free_finished(spark)
    info = both.where("kind is null").select("doc_id", "text_key", "n_shingles", "key", "sketch")
    classes = stored(
        info.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")),
        spark,
        "jaccard-classes",
    )
    info = stored(info.drop("sketch"), spark, "jaccard-info")
    found = both.where("kind is not null").select("kind", "a", "b", "n")
    free_finished(spark)
    sets = stored(able(found), spark, "jaccard-able")
    of_a, of_b = sets.select(F.col("key").alias("a")), sets.select(F.col("key").alias("b"))
    candidates = found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).join(of_a, "a", "left_semi").join(of_b, "b", "left_semi")
    near = stored(sketched(candidates, classes, s), spark, "jaccard-near")
    free_finished(spark)
    groups = found.where("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("key")).distinct().join(sets, "key", "left_semi")
    labels = link_up(spark, docs, classes, near, groups, s)
    forget(both, sets, near)
    # only linked classes have a label; the others are components of their own
    of = classes.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").select("key", "least", "label")
    least = of.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    linked_ = hub_join(of.where("label is not null").select("key", "label"), least, "label", labels.count())
    named = stored(linked_.select("key", "component_id").union(of.where("label is null").select("key", F.col("least").alias("component_id"))), spark, "jaccard-named")
    forget(classes, labels)
    free_finished(spark)
    return info.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "key", "text_key")


def link_up(spark: SparkSession, docs: DataFrame, classes: DataFrame, near: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """Labels (node, label), a stored table, after verifying what is needed to join the components."""
    asked = near.select(F.col("a").alias("key")).union(near.select(F.col("b").alias("key"))).distinct()
    texts = stored(texts_of(docs, classes, asked, s), spark, "jaccard-texts")
    free_finished(spark)
    # first one pair for each set, the one with most signatures; most components are whole then
    first = near.groupBy("b").agg(F.max(F.struct("n", -F.col("a"), "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = stored(verified(first, texts, s), spark, "jaccard-links")
    free_finished(spark)
    labels = connected(spark, links)
    forget(links)

    def joined(more: DataFrame) -> DataFrame:
        nonlocal labels
        old, labels = labels, relabelled(spark, labels, more)
        forget(old)
        free_finished(spark)
        return labels

    rest = stored(verified(apart(near, labels), texts, s), spark, "jaccard-links")
    free_finished(spark)
    if not rest.isEmpty():
        joined(rest)
    forget(rest)
    forget(texts)
    # groups that still hold several components, each membership read once
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = labels.withColumnRenamed("node", "key")
    of_group = stored(groups.join(named, "key", "left").select("group", "key", F.coalesce("label", "key").alias("label")), spark, "jaccard-open")
    clusters = connected(spark, near_forests(in_cells(of_group, s, s.part).join(classes.select("key", "n_shingles", "sketch"), "key"), s, parts))
    forget(of_group)
    free_finished(spark)
    if not clusters.isEmpty():
        of_cluster = clusters.select(F.col("node").alias("key"), F.col("label").alias("group")).join(named, "key", "left").withColumn("label", F.coalesce("label", "key"))
        of_cluster = stored(of_cluster.join(classes.select("key", "n_shingles"), "key"), spark, "jaccard-open")
        texts = stored(texts_of(docs, classes, of_cluster.select("key"), s), spark, "jaccard-texts")
        found = stored(links_in_cells(in_cells(of_cluster, s, max(1, s.part // 2)).join(texts, "key"), s, parts), spark, "jaccard-links")
        free_finished(spark)
        if not found.isEmpty():
            joined(found)
        forget(of_cluster, texts, found)
    forget(clusters)
    return labels


def relabelled(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only what these join is connected, and old labels follow it."""
    of = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    to = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = links.join(of, "a", "left").join(to, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    new = connected(spark, between)
    old = labels.select("node", F.col("label").alias("was")).join(new.select(F.col("node").alias("was"), "label"), "was", "left").select("node", F.coalesce("label", "was").alias("label"))
    out = stored(old.union(new.join(labels.select("node"), "node", "left_anti").select("node", "label")), spark, "labels")
    forget(new)
    return out


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    of = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    to = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(of, "a", "left").join(to, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "n")


def texts_of(docs: DataFrame, classes: DataFrame, keys: DataFrame, s: Settings) -> DataFrame:
    """(key, text): one text of each class asked for; copies of a text are one before they move, and of few classes no other text moves."""
    asked = classes.join(keys, "key").select("key", "text_key")
    docs = docs.select(text_key().alias("text_key"), "text")
    if keys.count() <= s.small:
        docs = docs.join(F.broadcast(asked.select("text_key").distinct()), "text_key", "left_semi")
    return docs.groupBy("text_key").agg(F.first("text").alias("text")).join(asked, "text_key").select("key", "text")


def representatives(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row of the least doc_id (null last, then by text); rows with the empty set all stay.

    Ids and keys are ranked by a map-side minimum; texts move in one semi-join.
    Other columns are carried along, whatever their names.
    """
    spark = docs.sparkSession
    labelled = stored(components(docs, s), spark, "jaccard-labelled")
    least = labelled.where("key is not null").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("one"))
    chosen = least.select("one.doc_id", "one.text_key").union(labelled.where("key is null").select("doc_id", "text_key"))
    chosen = stored(chosen.distinct(), spark, "jaccard-chosen")
    again = not labelled.where("key is not null").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty()
    forget(labelled)
    rows = carry(docs, F.col("doc_id"), text_key().alias("text_key"))
    kept = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["text_key"] == chosen["text_key"]), "left_semi")
    if again:  # rows that repeat in full: of those with words one stays
        has_words = F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
        kept = kept.where(has_words).dropDuplicates(["doc_id", "text_key"]).unionByName(kept.where(~F.coalesce(has_words, F.lit(False))))
    return kept.select(*[F.col("text") if c == "text" else F.col(CARRIED).getField(c).alias(c) for c in docs.columns])
