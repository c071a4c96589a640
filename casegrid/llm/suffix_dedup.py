"""Removal of repeated passages by a distributed, sparse suffix array.

Every byte covered by a string of ``span`` bytes that also starts anywhere else
is removed. Sorting all suffixes is not needed: each string of ``span`` bytes
has an anchor, its leftmost gram of least hash, and two equal strings have it at
the same place. So only the suffixes at anchors (about one in seventy) are
sorted, each with its context: the bytes of all strings that it anchors.

0. Equal texts are one class (128-bit key), whose text is written once. Classes
   of several rows lose all their bytes; every class takes part with one copy.
1. Suffixes at anchors are range-partitioned by their leading bytes, with
   splitters from a sample; a bucket sorts them by multikey quicksort (leading
   bytes, then gram, then context). Equal contexts decide all their strings at
   once. A context whose gram stands beside it in another context is open. Where
   a splitter cuts the run of a gram, the last suffix of the one bucket and the
   first of the next tell so, and the contexts at that boundary are open too.
2. The strings of open contexts share the hundred bytes right (or left) of the
   anchor: a suffix again. These are range-partitioned by sampled splitters, and
   the strings of a bucket sorted by multikey quicksort over 8-byte symbols;
   neighbours equal over ``span`` bytes are repeats. Strings beside bytes so
   frequent that they would fill a bucket are dealt singly by a 128-bit hash,
   after those that repeat inside a task have been decided there.

Defined results: null texts are empty; texts shorter than ``span`` lose nothing;
runs of one character are handled like any other text; a passage that repeats
inside one document counts; texts of any length are read in slices, so memory
grows with the text's own bytes alone; repeated rows lose all their bytes if they
have ``span``; ties don't arise (a byte is covered or not); an empty table gives
no rows; extra columns are carried along whatever their names, but one that is
named like a result column gives way to it.
"""

from __future__ import annotations

import functools
import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import carry, drawn, forget, free_finished, opened, refuse_empty, sample_share, stored, tidy

GRAM = 64


@dataclass(frozen=True)
class Settings:
    span: int = 200
    #: documents that set the splitters: a bound on balance, not on results
    sample: int = 2000
    #: bytes of these texts at most (as expected): long texts are drawn less often then
    sample_bytes: int = 64_000_000
    #: bytes that numpy handles at a time; longer texts are read in slices of so many string starts
    chunk: int = 1_000_000

    @property
    def side(self) -> int:
        return self.span // 2


@functools.lru_cache(maxsize=1)
def constants(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, powers of an odd base and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 2**64)
    values = np.random.default_rng(9173).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    powers = np.full(size, base, dtype=np.uint64)
    back = np.full(size, inverse, dtype=np.uint64)
    powers[0] = back[0] = 1
    with np.errstate(over="ignore"):
        return values, np.multiply.accumulate(powers), np.multiply.accumulate(back)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Anchors:
    """Columns of one row an anchor: number of the slice, place of the anchor, first and last string start, leading bytes, gram, context (two words)."""

    text: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    lead: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    second: np.ndarray


def anchors(texts: list[bytes], s: Settings) -> Anchors:
    """Anchors of all strings of ``span`` bytes inside each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    n = len(data)
    if n < s.span:
        none = np.empty(0, np.int64)
        word = none.astype(np.uint64)
        return Anchors(none, none, none, none, word, word, word, word)
    values, powers, back = constants(1 << max(21, int(n + 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * powers[:n], dtype=np.uint64)])
        gram = mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    bits = np.uint64(max(24, int(n).bit_length()))
    low = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    width = s.span - GRAM + 1
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    place = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    # string starts inside one text
    per_text = np.maximum(0, sizes - s.span + 1)
    start = np.repeat(begin - (np.cumsum(per_text) - per_text), per_text) + np.arange(per_text.sum())
    place = place[start]
    text = np.repeat(np.arange(len(texts)), per_text)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(start) else np.empty(0, np.int64)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    at, lo, hi = place[first], start[first], start[last]
    with np.errstate(over="ignore"):
        shape = ((at - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
        around = (sums[hi + s.span] - sums[lo]) * back[lo]
        context = mixed(around ^ shape * np.uint64(0xC2B2AE3D27D4EB4F))
        # a second word of the same bytes, summed with other values
        other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values)[data] * powers[:n], dtype=np.uint64)])
        second = mixed((other[hi + s.span] - other[lo]) * back[lo] + shape)
    wide = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    lead = np.ascontiguousarray(wide).view(">u8").ravel().astype(np.uint64)
    base = begin[text[first]]
    return Anchors(text[first], at - base, lo - base, hi - base, lead, gram[at], context, second)


def order_key(lead: np.ndarray, gram: np.ndarray, context: np.ndarray) -> np.ndarray:
    """The place of a suffix in the whole order as 24 bytes that compare like it: what the splitters cut."""
    return np.stack([lead, gram, context], axis=1).astype(">u8").view("S24").ravel()


def multikey_sort(columns: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """Order of rows by several key columns: multikey quicksort, breadth first.

    Each round sorts by one column and goes on to the next only with rows whose
    keys have been equal so far, all such groups at once.
    """
    order = np.arange(len(columns[0])) if rows is None else rows
    group = np.zeros(len(order), dtype=np.int64)
    open_ = np.arange(len(order))
    for column in columns:
        if not len(open_):
            break
        key = column[order[open_]]
        within = np.lexsort((key, group[open_]))
        order[open_] = order[open_][within]
        key, g = key[within], group[open_]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])])
        number = np.flatnonzero(new)[np.cumsum(new) - 1]
        group[open_] = open_[number]
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
    return order


def equal_strings(data: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Which of the strings of ``span`` bytes at ``starts`` equal another one: multikey quicksort over 8-byte symbols, only of those equal so far."""
    live = np.arange(len(starts))
    group = np.zeros(len(starts), dtype=np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    symbols = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for depth in [*range(0, span - 8, 8), span - 8]:
        key = np.ascontiguousarray(symbols[starts[live] + depth]).view("<u8").ravel()
        order = np.lexsort((key, group[live]))
        live, key = live[order], key[order]
        g = group[live]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])]) if len(live) else np.empty(0, bool)
        alone = new & np.append(new[1:], True) if len(live) else new
        group[live] = np.cumsum(new)
        live = live[~alone]
        if not len(live):
            break
    out = np.zeros(len(starts), dtype=bool)
    out[live] = True
    return out


PACKED = np.dtype([("tid", "<i8"), ("lead", "<u8"), ("gram", "<u8"), ("context", "<u8"), ("second", "<u8"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1"), ("flag", "u1")])
REPEATED, DECIDED = 1, 2  # flags: context repeats in its task; repeats and another row stands for it
REPEAT, OPEN, EDGE, BOUND = range(4)  # kinds of judged rows: all strings repeat; to be compared; open if its gram's run was cut; a gram at the end of a bucket
HOT = np.dtype([("a", "<u8"), ("b", "<u8"), ("tid", "<i8"), ("at", "<u4"), ("again", "u1")])


def text_keys(text: str = "text") -> tuple[Column, Column]:
    """128 bits of the text, as two columns."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), F.col(text)).alias("k2")


def text_classes(docs: DataFrame) -> DataFrame:
    """k1, k2, copies, n (bytes), text: one row for each different text; copies meet in a map-side aggregate."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.groupBy(*text_keys()).agg(F.count("*").alias("copies"), F.first("text").alias("text")).withColumn("n", F.octet_length("text").cast("long"))


def slices(rows: Iterator[tuple[int, str]], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(text ids, offsets, bytes) of about ``chunk`` bytes at a time; slices of a long text overlap by ``span`` - 1 bytes, so each string starts in one."""
    tids: list[int] = []
    offsets: list[int] = []
    texts: list[bytes] = []
    size = 0
    for tid, text in rows:
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - s.span + 1), s.chunk):
            part = data[at : at + s.chunk + s.span - 1]
            tids.append(tid)
            offsets.append(at)
            texts.append(part)
            size += len(part)
            if size >= s.chunk:
                yield np.array(tids, np.int64), np.array(offsets, np.int64), texts
                tids, offsets, texts, size = [], [], [], 0
    if tids:
        yield np.array(tids, np.int64), np.array(offsets, np.int64), texts


def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    for batch in batches:
        for tid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield tid, text.as_py()


def splitters(texts: DataFrame, s: Settings, buckets: int) -> np.ndarray:
    """Bounds of the ranges in the order of suffixes, from the anchors of a bounded sample of texts."""
    share = sample_share(texts, F.col("n"), s.sample, s.sample_bytes)
    sample = texts.where(drawn("tid", share)).select("tid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, parts in slices(pairs_of(batches), s):
            a = anchors(parts, s)
            yield pa.RecordBatch.from_arrays([pa.array(order_key(a.lead, a.gram, a.context).tolist(), pa.binary())], ["k"])

    got = np.sort(np.array(sample.mapInArrow(tidy(run), "k binary").toArrow().column("k").to_pylist(), dtype="S24"))
    refuse_empty(len(got) or sample.count(), share, "texts")
    return np.unique(got[(np.arange(1, buckets) * len(got)) // buckets]) if len(got) else got


def dealt_suffixes(texts: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """bucket, data: packed records of the suffixes at anchors."""
    shared = texts.sparkSession.sparkContext.broadcast(splitters(texts, s, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        held: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            rec = np.concatenate(held)
            held.clear()
            order = np.lexsort((rec["second"], rec["context"]))
            one, two = rec["context"][order], rec["second"][order]
            again = np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])])
            several = again | np.append(again[1:], False)
            flag = np.zeros(len(rec), np.uint8)
            flag[order[several]] |= REPEATED
            flag[order[again]] |= DECIDED
            rec["flag"] = flag
            bucket = np.searchsorted(bounds, order_key(rec["lead"], rec["gram"], rec["context"]), side="right")
            spread = (flag & DECIDED) > 0
            bucket[spread] = np.arange(spread.sum()) % buckets
            order = np.argsort(bucket, kind="stable")
            return packed_by(bucket[order], rec[order])

        size = 0
        for tids, offsets, parts in slices(pairs_of(batches), s):
            a = anchors(parts, s)
            rec = np.zeros(len(a.at), PACKED)
            rec["tid"], rec["lead"], rec["gram"], rec["context"], rec["second"] = tids[a.text], a.lead, a.gram, a.context, a.second
            rec["at"], rec["lo"], rec["hi"] = a.at + offsets[a.text], a.at - a.lo, a.at - a.hi
            held.append(rec)
            size += len(rec)
            if size > 1_500_000:
                yield made()
                size = 0
        if size:
            yield made()

    return texts.select("tid", "text").mapInArrow(tidy(run), "bucket int, data binary")


def packed_by(bucket: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, from records in order of bucket."""
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cut[1:], len(bucket))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array([rec[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())], pa.binary())], ["bucket", "data"])


def judged_suffixes(dealt: DataFrame, buckets: int) -> DataFrame:
    """kind, tid, at, lo, hi (starts of strings, both included), gram, bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, blobs = [], []
        for b in batches:
            numbers += b.column(0).to_pylist()
            blobs += b.column(1).to_pylist()
        if not blobs:
            return
        number = min(numbers)
        rec = np.concatenate([np.frombuffer(d, PACKED) for d in blobs])
        blobs.clear()
        passed = rec[(rec["flag"] & DECIDED) > 0]
        rec = rec[(rec["flag"] & DECIDED) == 0]
        rec = rec[multikey_sort([rec["lead"], rec["gram"], rec["context"], rec["second"]])]
        kind = np.zeros(0, np.int64)
        bounds = rec[:0]
        if len(rec):
            new_gram = np.concatenate([[True], rec["gram"][1:] != rec["gram"][:-1]])
            new = new_gram | np.concatenate([[True], (rec["context"][1:] != rec["context"][:-1]) | (rec["second"][1:] != rec["second"][:-1])])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(rec)))
            repeats = np.repeat((count > 1) | (np.bitwise_or.reduceat(rec["flag"], first) & REPEATED > 0), count)
            gram_first = np.flatnonzero(new_gram)
            run_of = np.cumsum(new_gram) - 1
            kinds = np.add.reduceat(new.astype(np.int64), gram_first)
            shared = kinds[run_of] > 1
            edge = ((run_of == 0) | (run_of == len(gram_first) - 1)) & ~shared
            # a repeated context's strings are known, but one row of it still speaks for it beside other contexts of its gram
            look = np.where(shared, OPEN, np.where(edge, EDGE, -1))
            kind = np.where(new, look, -1)
            bounds = rec[[0, -1]] if rec["gram"][0] != rec["gram"][-1] else rec[:1]
        for part, what in ((passed, REPEAT), (rec[repeats] if len(rec) else rec, REPEAT), (rec[kind == OPEN], OPEN), (rec[kind == EDGE], EDGE), (bounds, BOUND)):
            at = part["at"].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), what, np.int32)), pa.array(part["tid"]), pa.array(at), pa.array(at - part["lo"]), pa.array(at - part["hi"]), pa.array(part["gram"].view(np.int64)), pa.array(np.full(len(part), number, np.int32))],
                ["kind", "tid", "at", "lo", "hi", "gram", "bucket"],
            )

    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(run), "kind int, tid long, at long, lo long, hi long, gram long, bucket int")


def open_contexts(judged: DataFrame) -> DataFrame:
    """tid, at, lo, hi: contexts to be compared, those at a boundary among them whose gram goes on in the next bucket."""
    cut = judged.where(F.col("kind") == BOUND).groupBy("gram").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a < b")
    edges = judged.where(F.col("kind") == EDGE).join(cut, "gram", "left_semi")
    return judged.where(F.col("kind") == OPEN).select("tid", "at", "lo", "hi").union(edges.select("tid", "at", "lo", "hi"))


def halves(data: bytes, spots: list[dict], s: Settings) -> Iterator[tuple[bytes, int, int]]:
    """(bytes that all strings share, first start, last start): the strings from side bytes before the anchor on hold as many from it on, those before hold what is ahead of it."""
    for spot in spots:
        at, lo, hi = spot["at"], spot["lo"], spot["hi"]
        middle = max(lo, at - s.side)
        if middle <= hi:
            yield data[at : at + s.side], middle, hi
        if lo < middle:
            yield data[at - s.side : at], lo, min(hi, middle - 1)


def open_texts(texts: DataFrame, spots: DataFrame) -> DataFrame:
    listed = spots.groupBy("tid").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("spots"))
    return texts.select("tid", "text").join(listed, "tid").select("tid", "text", "spots")


def shared_splitters(texts: DataFrame, spots: DataFrame, s: Settings, buckets: int) -> tuple[list[bytes], set[bytes]]:
    """(bounds of ranges, frequent ones) of the bytes that the strings of open contexts share, from a bounded sample of texts."""
    held = texts.select("tid", "n").join(spots.select("tid").distinct(), "tid", "left_semi")
    share = sample_share(held, F.col("n"), s.sample, s.sample_bytes)
    sample = spots.where(drawn("tid", share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [core for text, spots_ in zip(batch.column(1), batch.column(2).to_pylist()) for core, _, _ in halves(text.as_py().encode("utf-8", "surrogatepass"), spots_, s)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["k"])

    got = sorted(open_texts(texts, sample).mapInArrow(tidy(run), "k binary").toArrow().column("k").to_pylist())
    refuse_empty(len(got), share, "texts with open contexts")
    often = max(8, len(got) // (2 * buckets))
    hot = {core for core, n in Counter(got).items() if n >= often}
    rest = [core for core in got if core not in hot]
    return sorted({rest[k * len(rest) // buckets] for k in range(1, buckets)}) if rest else [], hot


def dealt_strings(texts: DataFrame, spots: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """bucket, tid, lo, data: the bytes of open contexts, in ranges of what their strings share; or, with tid null, packed hashes of the strings beside frequent bytes."""
    shared = texts.sparkSession.sparkContext.broadcast(shared_splitters(texts, spots, s, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, hot = shared.value
        held: list[np.ndarray] = []

        def made(everything: np.ndarray) -> pa.RecordBatch:
            """Strings that repeat here are one row with a mark and, for the others, rows that are dealt anywhere."""
            order = multikey_sort([everything["a"], everything["b"]])
            rec = everything[order]
            again = np.concatenate([[False], (rec["a"][1:] == rec["a"][:-1]) & (rec["b"][1:] == rec["b"][:-1])])
            rec["again"] = np.where(again, 2, np.append(again[1:], False))
            bucket = np.where(again, np.arange(len(rec)) % buckets, rec["a"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            made_ = packed_by(bucket[order], rec[order])
            n = len(made_)
            return pa.RecordBatch.from_arrays([made_.column(0), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), made_.column(1)], ["bucket", "tid", "lo", "data"])

        size = 0
        for batch in batches:
            bucket, tids, los, datas = [], [], [], []
            for tid, text, spots_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for core, lo, hi in halves(data, spots_, s):
                    if core in hot:
                        rec = np.zeros(hi - lo + 1, HOT)
                        words = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[p : p + s.span]) for p in range(lo, hi + 1)]), ">u8").reshape(-1, 2)
                        rec["a"], rec["b"], rec["tid"], rec["at"] = words[:, 0], words[:, 1], tid, np.arange(lo, hi + 1)
                        held.append(rec)
                        size += len(rec)
                    else:
                        bucket.append(bisect_right(bounds, core))
                        tids.append(tid)
                        los.append(lo)
                        datas.append(data[lo : hi + s.span])
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(tids, pa.int64()), pa.array(los, pa.int64()), pa.array(datas, pa.binary())], ["bucket", "tid", "lo", "data"])
            if size > 2_000_000:
                yield made(np.concatenate(held))
                held.clear()
                size = 0
        if held:
            yield made(np.concatenate(held))

    return open_texts(texts, spots).mapInArrow(tidy(run), "bucket int, tid long, lo long, data binary")


def runs_of(tid: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """tid, lo, hi: runs of neighbouring starts."""
    order = np.lexsort((at, tid))
    tid, at = tid[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (tid[1:] != tid[:-1]) | (at[1:] > at[:-1] + 1)])) if len(tid) else np.empty(0, np.int64)
    last = np.append(first[1:], len(tid)) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(tid[first]), pa.array(at[first]), pa.array(at[last])], ["tid", "lo", "hi"])


def repeats(dealt: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """tid, lo, hi: runs of string starts that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tids, los, datas, hashes = [], [], [], []
        for batch in batches:
            for tid, lo, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if tid is None:
                    hashes.append(np.frombuffer(data, HOT))
                else:
                    tids.append(tid)
                    los.append(lo)
                    datas.append(data)
        if hashes:
            rec = np.concatenate(hashes)
            hashes.clear()
            yield runs_of(rec["tid"][rec["again"] == 2], rec["at"][rec["again"] == 2].astype(np.int64))
            rec = rec[rec["again"] < 2]
            rec = rec[multikey_sort([rec["a"], rec["b"]])]
            new = np.concatenate([[True], (rec["a"][1:] != rec["a"][:-1]) | (rec["b"][1:] != rec["b"][:-1])])[: len(rec)]
            if len(rec):
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(rec)))
                same = np.repeat((count > 1) | (np.bitwise_or.reduceat(rec["again"], first) > 0), count)
                yield runs_of(rec["tid"][same], rec["at"][same].astype(np.int64))
        if not tids:
            return
        data = np.frombuffer(b"".join(datas), np.uint8)
        sizes = np.array([len(d) for d in datas], dtype=np.int64)
        datas.clear()
        count = sizes - s.span + 1
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(tids)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        same = np.flatnonzero(equal_strings(data, begin[owner] + inside, s.span))
        yield runs_of(np.array(tids, np.int64)[owner[same]], np.array(los, np.int64)[owner[same]] + inside[same])

    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(tidy(run), "tid long, lo long, hi long")


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left) for half-open spans."""
    removed = runs = at = 0
    left = []
    end = -1
    for lo, hi in sorted(spans):
        lo, hi = max(lo, 0), min(hi, len(data))
        if hi <= lo:
            continue
        if lo > end:
            left.append(data[max(0, at) : lo])
            runs += 1
            removed += hi - lo
            at = end = hi
        elif hi > end:
            removed += hi - end
            at = end = hi
    left.append(data[at:])
    return removed, runs, b"".join(left)


def judged_classes(texts: DataFrame, s: Settings, with_text: bool) -> DataFrame:
    """k1, k2, n_bytes, n_removed, n_spans, left (hash or text) of each row of ``texts``, the stored classes with their number tid."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = texts.where(F.col("n") >= s.span)
    judged = stored(judged_suffixes(dealt_suffixes(long, s, buckets), buckets), spark, "suffix-judged")
    free_finished(spark)
    spots = open_contexts(judged)
    found = stored(repeats(dealt_strings(long, spots, s, buckets), s, buckets), spark, "suffix-found")
    free_finished(spark)
    spans = judged.where(F.col("kind") == REPEAT).select("tid", "lo", "hi").union(found)
    listed = spans.groupBy("tid").agg(F.collect_list(F.struct("lo", (F.col("hi") + s.span).alias("hi"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, kept = [], [], [], []
            for copies, text, spans_ in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist()):
                data = text.as_py().encode("utf-8", "surrogatepass")
                whole = [(0, len(data))] if copies > 1 and len(data) >= s.span else [(x["lo"], x["hi"]) for x in spans_ or ()]
                a, b, left = cut_spans(data, whole)
                size.append(len(data))
                gone.append(a)
                runs.append(b)
                kept.append(left.decode("utf-8", "ignore") if with_text else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "left"])

    joined = texts.join(listed, "tid", "left").select("k1", "k2", "copies", "text", "spans")
    out = stored(joined.mapInArrow(tidy(run), "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, left string"), spark, "suffix-classes")
    forget(judged, found)
    free_finished(spark)
    return out


def dedup(docs: DataFrame, s: Settings = Settings(), with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` but text, then n_bytes, n_removed, n_spans, and kept_sha256 or (``with_text``) left_text: the remaining bytes as text, without parts of characters that a cut left over.

    Texts move once a class, never with the rows: these join the classes'
    results by their keys.
    """
    spark = docs.sparkSession
    texts = stored(text_classes(docs).withColumn("tid", F.monotonically_increasing_id()), spark, "suffix-texts")
    free_finished(spark)
    done = judged_classes(texts, s, with_text)
    forget(texts)
    rows = carry(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))), *text_keys()).drop("text")
    name = "left_text" if with_text else "kept_sha256"
    return opened(rows.join(done.withColumnRenamed("left", name), ["k1", "k2"]), docs, ["n_bytes", "n_removed", "n_spans", name])
