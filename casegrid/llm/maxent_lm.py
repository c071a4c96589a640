"""Language-model scoring with a hashed maximum-entropy model.

Outcomes are factored: a softmax over classes, then a softmax inside the class.
The most frequent words (``head``) are in classes of equal size by frequency;
every other word falls into a class by its ending and in it into a cell by its
hash, in which it has its smoothed count share; so unseen words have a
probability too and all outcomes sum to one. Features are the preceding word
(one outside the head by a mark of its hash), the pair of preceding words, and
two skips, over one word and over two (words outside the head by their class),
each hashed into its own region of one weight table; inside a class they are the
preceding word and the one before it. The head and the tables grow
with the training tokens, up to sizes that can be broadcast (``Settings.grown``).

Training makes three passes over all training text, one or two feature kinds a
pass. In a pass every task sums observed and expected feature counts under the
current weights; the sums are added by rows of the table over the cluster, and the
weights take a few steps along the gradient (observed less expected, scaled by
the mean of both), expected counts being weighted anew after each. Counts of words cover all
training text and are shuffled with map-side sums.

Texts are tokenized twice, for the counts and into symbols (16 bits a token),
which are written once; training and scoring read these. Counts of rare words
come from a join on the word's 64-bit hash.

Defined results: null and empty texts are the end token alone; with no training
text every word is unseen and both scores stay finite; null ids are held by
their own hash; repeated rows and ties are scored one by one, alike; an empty
table gives no rows; long texts take memory in proportion to the longest alone;
extra columns are carried along whatever their names, but one that is named like
a result column gives way to it.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import CARRIED, carry, opened, stored, tidy, widened

END = b""
#: feature kinds of a token's class, and of the word or cell inside it
N_FEATURES, N_INNER = 4, 2
#: the class and inner kinds that each pass over the training text moves
PASSES = (((0,), (0,)), ((1,), (1,)), ((2, 3), ()))


@dataclass(frozen=True)
class Settings:
    #: words of the softmax over words, the end token among them; the least and the most
    head: int = 1024
    most_head: int = 4096
    #: words, or cells, of a class
    width: int = 32
    #: classes of other words: the most frequent endings, and one for all other endings
    endings: int = 48
    #: hashes of other words of a class that features tell apart; a cell has an equal share of them
    marks: int = 32
    #: rows of the hashed tables for classes and for what is inside a class; the least and the most
    rows: int = 32_768
    most_rows: int = 131_072
    #: training tokens for each row
    tokens_per_row: int = 4096
    #: gradient steps on the sums of a pass, and counts that are added to both of its sums
    steps: int = 6
    damping: float = 30.0
    #: words whose counts are broadcast; the others' come by the join
    frequent: int = 200_000
    #: tokens of a numpy batch, and of the documents that are read together
    batch: int = 2048
    group: int = 200_000

    def grown(self, tokens: int) -> "Settings":
        """The head grows with the square root of the training tokens, the tables and the marks in line with them, all in powers of two."""
        power = lambda x: 1 << max(0, int(x)).bit_length() >> 1
        head = max(self.head, min(self.most_head, power(tokens**0.5 / 8)))
        rows = max(self.rows, min(self.most_rows, power(2 * tokens / self.tokens_per_row)))
        width = self.width if head < 4 * self.head else 2 * self.width
        return replace(self, head=head, width=width, marks=self.marks * width // self.width * max(1, rows // self.rows), rows=rows)


def split(text: str | None) -> list[bytes]:
    return [*(text.encode("utf-8", "surrogatepass").lower().split() if text else ()), END]


def ending(word: bytes) -> bytes:
    """The last two bytes of the word without ASCII punctuation behind."""
    return word.rstrip(b".,;:!?'\")")[-2:]


def hashed(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word, 42)
    return value - 2**64 if value >= 2**63 else value


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all texts: summed in each task, then shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py()))
                if len(seen) > 400_000:
                    yield made()
        if seen:
            yield made()

    return texts.mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    settings: Settings
    total: int  # N
    kinds: int  # V
    head: dict[bytes, int]
    head_counts: np.ndarray
    endings: dict[bytes, int]
    tail_total: np.ndarray  # by ending class and cell: tokens outside the head
    tail_kinds: np.ndarray
    frequent: np.ndarray  # sorted hashes
    frequent_counts: np.ndarray

    @property
    def n_head_classes(self) -> int:
        return -(-self.settings.head // self.settings.width)

    @property
    def n_classes(self) -> int:
        return self.n_head_classes + self.settings.endings

    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, place in the class, and coarse number of each symbol."""
        s = self.settings
        symbol = np.arange(s.head + s.endings * s.marks)
        beyond = np.maximum(symbol - s.head, 0)
        at_head = symbol < s.head
        inside = np.where(at_head, symbol % s.width, beyond % s.marks % s.width)
        of = np.where(at_head, symbol // s.width, self.n_head_classes + beyond // s.marks)
        return of, inside, np.where(at_head, symbol, s.head + beyond // s.marks)


def mark(h: np.ndarray, s: Settings) -> np.ndarray:
    """Which of its class's marks a word's hash is; the cell is the mark modulo the width."""
    return (h.astype(np.int64).view(np.uint64) >> np.uint64(40)).astype(np.int64) % s.marks


def gather_vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    """Totals, the head, sums by ending and cell and the frequent words' counts: bounded by the settings and 65,793 endings."""
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    settings = settings.grown(int(total))
    top = counts.orderBy(F.desc("n"), "word")
    head_rows = top.limit(settings.head).collect()
    head = {bytes(r["word"]): k for k, r in enumerate(head_rows)}

    def sums_by(endings: dict[bytes, int] | None) -> DataFrame:
        """Sums over words outside the head, by ending, or by class and cell as eight bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[bytes, list[int]] = {}
            for batch in batches:
                words = batch.column(0).to_pylist()
                cells = (mark(np.array([hashed(w) for w in words], np.int64), settings) % settings.width).tolist() if endings is not None else words
                for word, n, cell in zip(words, batch.column(1).to_pylist(), cells):
                    if word not in head:
                        key = ending(word)
                        if endings is not None:
                            key = (endings.get(key, settings.endings - 1) * settings.width + cell).to_bytes(8, "big")
                        got = sums.setdefault(key, [0, 0])
                        got[0] += n
                        got[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["e", "n", "v"])

        return counts.select("word", "n").mapInArrow(tidy(run), "e binary, n long, v long").groupBy("e").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))

    listed = sorted(sums_by(None).collect(), key=lambda r: (-r["n"], bytes(r["e"])))
    endings = {bytes(r["e"]): k for k, r in enumerate(listed[: settings.endings - 1])}
    tail_total, tail_kinds = np.zeros(settings.endings * settings.width), np.zeros(settings.endings * settings.width)
    for r in sums_by(endings).collect():
        k = int.from_bytes(bytes(r["e"]), "big")
        tail_total[k], tail_kinds[k] = r["n"], r["v"]
    often = top.limit(settings.frequent).select(F.xxhash64("word").alias("h"), "n").toArrow()
    h, n = often.column("h").to_numpy(), often.column("n").to_numpy()
    order = np.argsort(h)
    shape = (settings.endings, settings.width)
    return Vocabulary(settings, int(total), int(kinds), head, np.array([r["n"] for r in head_rows], dtype=np.float64), endings, tail_total.reshape(shape), tail_kinds.reshape(shape), h[order], n[order])


@dataclass
class Model:
    settings: Settings
    bias: np.ndarray  # log share of each class
    inner: np.ndarray  # classes x width: log share of a word or cell in its class
    classes: np.ndarray  # rows x n_classes
    words: np.ndarray  # rows x width

    @classmethod
    def start(cls, v: Vocabulary) -> "Model":
        s = v.settings
        counts = np.full(v.n_head_classes * s.width, -1.0)
        counts[: len(v.head_counts)] = v.head_counts
        grid = np.concatenate([counts.reshape(v.n_head_classes, s.width), v.tail_total])
        there = grid >= 0
        mass = np.where(there, grid + 0.5, 0.0)
        by_class = mass.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = np.where(there, np.log(mass / by_class[:, None]), -1e4)
            bias = np.where(by_class > 0, np.log(by_class / by_class.sum()), -1e4)
        return cls(s, bias.astype(np.float32), inner.astype(np.float32), np.zeros((s.rows, v.n_classes), np.float32), np.zeros((s.rows, s.width), np.float32))


class Numbers(dict):
    """Numbers keys as they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        k = self[key] = len(self)
        return k


class Reader:
    """Texts as symbols. Each different word is looked up once; its number keeps its symbol, hash and count."""

    LIMIT = 500_000

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.known = 0
        self.symbol, self.hash, self.count, self.listed = (np.empty(0, t) for t in (np.int32, np.int64, np.int64, bool))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, lengths); the numbers hold until the next call."""
        if len(self.index) > self.LIMIT:
            self.clear()
        index, out, sizes = self.index, [], []
        for text in texts:
            tokens = split(text)
            sizes.append(len(tokens))
            out += map(index.__getitem__, tokens)
        if len(index) > self.known:
            self.extend(list(index)[self.known :])
            self.known = len(index)
        return np.array(out, dtype=np.int64), np.array(sizes, dtype=np.int64)

    def extend(self, new: list[bytes]) -> None:
        v, s = self.v, self.v.settings
        h = np.array([hashed(w) for w in new], dtype=np.int64)
        symbol = np.array([v.head.get(w, -1) for w in new], dtype=np.int64)
        of = np.array([v.endings.get(ending(w), s.endings - 1) for w in new], dtype=np.int64)
        symbol = np.where(symbol >= 0, symbol, s.head + of * s.marks + mark(h, s)).astype(np.int32)
        if len(v.frequent):
            at = np.minimum(np.searchsorted(v.frequent, h), len(v.frequent) - 1)
            listed = v.frequent[at] == h
            count = np.where(listed, v.frequent_counts[at], 0)
        else:
            listed, count = np.zeros(len(new), dtype=bool), np.zeros(len(new), dtype=np.int64)
        self.symbol, self.hash = np.concatenate([self.symbol, symbol]), np.concatenate([self.hash, h])
        self.count, self.listed = np.concatenate([self.count, count]), np.concatenate([self.listed, listed])


MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def region(kind: int, kinds: int, size: int, *values: np.ndarray) -> np.ndarray:
    """Rows of a feature kind's own region of a table of ``size`` rows; both are powers of two."""
    part = size // kinds
    with np.errstate(over="ignore"):
        x = (values[0] + np.uint64(1)) * np.uint64(MIX[0])
        for value in values[1:]:
            x ^= x >> np.uint64(31)
            x += value * np.uint64(MIX[1])
            x *= np.uint64(MIX[0])
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(65 - part.bit_length())).astype(np.int64) + kind * part


def powers(rows: list[np.ndarray], table: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, their exponentials, sums of these): start plus the sum of the table's rows. Scores stay far from overflow: a step moves a weight by two at most."""
    z = table.take(rows[0], axis=0)
    part = np.empty_like(z)
    for r in rows[1:]:
        z += table.take(r, axis=0, out=part, mode="clip")
    z += start
    e = np.exp(z, out=part)
    return z, e, e.sum(axis=1)


def _scatter(rows: np.ndarray, p: np.ndarray, due: np.ndarray) -> None:
    """due[row of token] += p of the token: the first few tokens of every row layer by layer, the rest of frequent rows by runs."""
    order = np.argsort(rows.astype(np.uint16) if len(due) <= 2**16 else rows, kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    count = np.diff(np.append(first, len(ranked)))
    for layer in range(4):
        at = first[count > layer] + layer
        if len(at):
            due[ranked[at]] += p.take(order[at], axis=0)
    long = count > 4
    if long.any():
        size = count[long] - 4
        starts = np.cumsum(size) - size
        at = np.repeat(first[long] + 4 - starts, size) + np.arange(size.sum())
        due[ranked[first[long]]] += np.add.reduceat(p.take(order[at], axis=0), starts, axis=0)


class Rows(dict):
    """Table rows of each feature kind, found when they are first asked for."""

    def __init__(self, find: Callable[[int], np.ndarray]):
        super().__init__()
        self.find = find

    def __missing__(self, kind: int) -> np.ndarray:
        self[kind] = self.find(kind)
        return self[kind]


class Features:
    """The sparse features and outcomes of a group of documents, from their symbols."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, v: Vocabulary, layout: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.s, self.v = v.settings, v
        of, inside, coarse = layout or v.layout()
        self.of, self.inside = of[symbols], inside[symbols]
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        @functools.cache
        def back(k: int, fine: bool = False) -> np.ndarray:
            """The symbol, fine or coarse, k tokens before, and 0 before the first."""
            out = np.zeros(len(symbols), dtype=np.uint64)
            out[k:] = (symbols if fine else coarse[symbols])[: len(symbols) - k] + 1
            out[place < k] = 0
            return out

        values = (lambda: (back(1, True),), lambda: (back(1), back(2)), lambda: (back(2),), lambda: (back(3),))
        inner = (lambda: (back(1, True), self.of.astype(np.uint64)), lambda: (back(2), self.of.astype(np.uint64)))
        self.rows = Rows(lambda k: region(k, N_FEATURES, self.s.rows, *values[k]()))
        self.inner_rows = Rows(lambda k: region(k, N_INNER, self.s.rows, *inner[k]()))

    def spans(self) -> Iterator[slice]:
        """Runs of tokens so small that their dense scores stay in the processor's cache."""
        for lo in range(0, len(self.of), self.s.batch):
            yield slice(lo, lo + self.s.batch)

    def log_prob(self, m: Model) -> np.ndarray:
        """Natural log of the probability of each token's class, and in it of its word or cell."""
        out = np.empty(len(self.of))
        for part in self.spans():
            of, inside = self.of[part], self.inside[part]
            at = np.arange(len(of))
            z, _, total = powers([self.rows[k][part] for k in range(N_FEATURES)], m.classes, m.bias)
            w, _, below = powers([self.inner_rows[k][part] for k in range(N_INNER)], m.words, m.inner[of])
            out[part] = z[at, of] - np.log(total) + w[at, inside] - np.log(below)
        return out

    def add_to(self, m: Model, number: int, sums: list[np.ndarray]) -> None:
        """Add observed and expected counts of a pass: sums = [class observed, class expected, inner observed, inner expected]."""
        moved, moved_inner = PASSES[number]
        ready, ready_inner = ([k for done in PASSES[:number] for k in done[which]] for which in (0, 1))
        for seen, rows, kinds, outcome in ((sums[0], self.rows, moved, self.of), (sums[2], self.inner_rows, moved_inner, self.inside)):
            for k in kinds:
                seen += np.bincount(rows[k] * seen.shape[1] + outcome, minlength=seen.size).reshape(seen.shape)
        if ready:
            for part in self.spans():
                of = self.of[part]
                _, e, total = powers([self.rows[k][part] for k in ready], m.classes, m.bias)
                e /= total[:, None]
                for k in moved:
                    _scatter(self.rows[k][part], e, sums[1])
                if moved_inner:
                    _, e, total = powers([self.inner_rows[k][part] for k in ready_inner], m.words, m.inner[of])
                    e /= total[:, None]
                    for k in moved_inner:
                        _scatter(self.inner_rows[k][part], e, sums[3])
            return
        # without weights every token has the same class probabilities, and what is inside depends on the class alone
        for k in moved:
            sums[1] += np.bincount(self.rows[k], minlength=len(sums[1]))[:, None] * np.exp(m.bias)[None]
        n = self.v.n_classes
        for k in moved_inner:
            times = np.bincount(self.inner_rows[k] * n + self.of, minlength=len(sums[3]) * n).reshape(-1, n)
            sums[3] += times @ np.exp(m.inner)


#: rows of a table that travel together when sums are added up
BLOCK = 64


def table_sums(symbols: DataFrame, model: Model, v: Vocabulary, number: int) -> list[np.ndarray]:
    """Observed and expected counts of one pass, summed over the cluster by block of the tables; a task sends the rows that it met."""
    spark = symbols.sparkSession
    shared = spark.sparkContext.broadcast((model, v))
    shapes = [model.classes.shape, model.classes.shape, model.words.shape, model.words.shape]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vocabulary = shared.value
        layout = vocabulary.layout()
        sums = [np.zeros(shape, np.float32) for shape in shapes]
        total = [np.zeros(shape) for shape in shapes]
        for codes, sizes in symbol_groups(batches, vocabulary.settings.group):
            Features(codes, sizes, vocabulary, layout).add_to(m, number, sums)
            for whole, part in zip(total, sums):
                whole += part
                part[:] = 0
        keys, rows, data = [], [], []
        for k, whole in enumerate(total):
            met = np.flatnonzero(whole.any(axis=1))
            for at in np.split(met, np.flatnonzero(np.diff(met // BLOCK)) + 1) if len(met) else ():
                keys.append(k << 32 | int(at[0]) // BLOCK)
                rows.append((at % BLOCK).astype(np.uint8).tobytes())
                data.append(whole[at].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary()), pa.array(data, pa.binary())], ["block", "rows", "data"])

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_ = key[0].as_py()
        whole = np.zeros((BLOCK, shapes[number_ >> 32][1]))
        for batch in batches:
            for rows, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                whole[np.frombuffer(rows, np.uint8)] += np.frombuffer(data, np.float32).reshape(-1, whole.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([number_], pa.int64()), pa.array([whole.astype(np.float32).tobytes()], pa.binary())], ["block", "data"])

    out = [np.zeros((-(-shape[0] // BLOCK) * BLOCK, shape[1])) for shape in shapes]
    for r in symbols.mapInArrow(tidy(run), "block long, rows binary, data binary").groupBy("block").applyInArrow(added, "block long, data binary").collect():
        k, at = r["block"] >> 32, (r["block"] & (2**32 - 1)) * BLOCK
        out[k][at : at + BLOCK] = np.frombuffer(r["data"], np.float32).reshape(BLOCK, -1)
    shared.unpersist()
    return [whole[: shape[0]] for whole, shape in zip(out, shapes)]


def symbol_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, lengths) of documents of about ``size`` tokens together, from one binary column."""
    held, sizes, n = [], [], 0
    for batch in batches:
        for data in batch.column(0):
            held.append(data.as_buffer())
            sizes.append(len(held[-1]) // 2)
            n += sizes[-1]
            if n >= size:
                yield np.concatenate([np.frombuffer(h, "<u2") for h in held]).astype(np.int64), np.array(sizes, np.int64)
                held, sizes, n = [], [], 0
    if held:
        yield np.concatenate([np.frombuffer(h, "<u2") for h in held]).astype(np.int64), np.array(sizes, np.int64)


def token_groups(texts: Iterator[str | None], size: int) -> Iterator[list[str | None]]:
    group: list[str | None] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text or "") + 6
        if held > 6 * size:
            yield group
            group, held = [], 0
    if group:
        yield group


def ascended(seen: np.ndarray, expected: np.ndarray, steps: int) -> np.ndarray:
    """Moves of the weights of rows by gradient steps (observed less expected, over the mean of both); after each, expected counts are weighted anew by the moves so far."""
    moved = np.zeros(seen.shape)
    mass = seen.sum(axis=1, keepdims=True)
    for _ in range(steps):
        now = expected * np.exp(moved)
        now *= mass / now.sum(axis=1, keepdims=True)
        moved += (seen - now) / ((seen + now) / 2)
    return moved


def step(model: Model, sums: list[np.ndarray], number: int, s: Settings) -> Model:
    """The gradient steps of a pass's kinds, shared by kinds that move together."""
    share = s.damping * np.maximum(np.exp(model.bias), 1e-9)[None]  # a class without words is never an outcome
    classes, words = model.classes.astype(np.float64), model.words.astype(np.float64)
    for table, kinds, n_kinds, seen, expected, prior in ((classes, PASSES[number][0], N_FEATURES, sums[0], sums[1], share), (words, PASSES[number][1], N_INNER, sums[2], sums[3], s.damping / s.width)):
        part = s.rows // n_kinds
        for k in kinds:
            rows = slice(k * part, (k + 1) * part)
            table[rows] += ascended(seen[rows] + prior, expected[rows] + prior, s.steps) / len(kinds)
    return Model(s, model.bias, model.inner, classes.astype(np.float32), words.astype(np.float32))


def in_symbols(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """carried_row, learn, row, symbols, n_tokens, n_known, base, tail (log10 shares of other words in their cells), and the words that are not among the broadcast counts, with their times.

    ``docs``: carried_row, text, learn (true: training text).
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        s = vocabulary.settings
        reader = Reader(vocabulary)
        of, inside, _ = vocabulary.layout()
        log_base = np.log10(vocabulary.total + vocabulary.kinds + 1.0)
        log_tail = np.log10(vocabulary.tail_total + vocabulary.tail_kinds + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            done = 0
            for group in token_groups((t.as_py() for t in batch.column(1)), s.group):
                numbers, sizes = reader.numbers(group)
                starts = np.cumsum(sizes) - sizes
                symbols, count, listed = reader.symbol[numbers], reader.count[numbers], reader.listed[numbers]
                logs = np.log10(count + 1.0)
                beyond = np.maximum(of[symbols] - vocabulary.n_head_classes, 0)
                tail = np.where(symbols >= s.head, logs - log_tail[beyond, inside[symbols]], 0.0)
                apart = np.flatnonzero(~listed)
                pair = np.repeat(np.arange(len(group)), sizes)[apart] * (len(reader.hash) + 1) + numbers[apart]
                pair, times = np.unique(pair, return_counts=True)
                owner, number = pair // (len(reader.hash) + 1), pair % (len(reader.hash) + 1)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(group)))]).astype(np.int32)
                flat = symbols.astype("<u2").tobytes()
                edges = (2 * np.append(starts, len(symbols))).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(group)), batch.column(2).slice(done, len(group)), pa.array(row + np.arange(len(group))), pa.array([flat[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                        pa.array(sizes), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(logs, starts) - sizes * log_base), pa.array(np.add.reduceat(tail, starts)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(reader.hash[number])), pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
                    ],
                    [CARRIED, "learn", "row", "symbols", "n_tokens", "n_known", "base", "tail", "rare", "times"],
                )
                row += len(group)
                done += len(group)

    return docs.mapInArrow(tidy(run), widened(docs, ("text",), "row long, symbols binary, n_tokens long, n_known long, base double, tail double, rare array<long>, times array<int>"))


def train(symbols: DataFrame, v: Vocabulary) -> Model:
    """``symbols`` has the one column symbols, of training rows only."""
    model = Model.start(v)
    if v.total:
        for number in range(len(PASSES)):
            model = step(model, table_sums(symbols, model, v, number), number, v.settings)
    return model


def score(read: DataFrame, model: Model, v: Vocabulary, counts: DataFrame) -> DataFrame:
    """carried_row, n_tokens, n_known, train_tokens, base_score, score; ``read`` is the stored table of ``in_symbols``.

    One narrow pass; of each document the words that are not among the broadcast
    counts join the counts by hash.
    """
    shared = read.sparkSession.sparkContext.broadcast((model, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vocabulary = shared.value
        layout = vocabulary.layout()
        for batch in batches:
            at = 0
            for codes, sizes in symbol_groups(iter([batch.select(["symbols"])]), vocabulary.settings.group):
                logs = Features(codes, sizes, vocabulary, layout).log_prob(m) / np.log(10)
                part = batch.slice(at, len(sizes))
                total = np.add.reduceat(logs, np.cumsum(sizes) - sizes) + part.column("tail").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (CARRIED, "row", "n_tokens", "n_known", "base")), pa.array(total)], [CARRIED, "row", "n_tokens", "n_known", "base", "all"])
                at += len(sizes)

    made = read.select(CARRIED, "row", "n_tokens", "n_known", "base", "tail", "symbols")
    made = made.mapInArrow(tidy(run), widened(made, ("tail", "symbols"), "all double"))
    rare = read.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    lookup = counts.select(F.xxhash64("word").alias("h"), "n")
    found = rare.join(lookup, "h").groupBy("row").agg(F.sum("times").alias("seen"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    zero = F.lit(0.0)
    return made.join(found, "row", "left").select(
        CARRIED,
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", zero)).alias("base_score"),
        (F.col("all") + F.coalesce("more", zero)).alias("score"),
    )


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs``: text, held_out and any others; learns from the rows that are not held out and scores all."""
    spark = docs.sparkSession
    learn = ~F.coalesce("held_out", F.lit(False))
    counts = stored(count_words(docs.where(learn).select(F.col("text").cast("string").alias("text"))), spark, "lm-counts")
    v = gather_vocabulary(counts, settings)
    read = stored(in_symbols(carry(docs, learn.alias("learn")), v), spark, "lm-symbols")
    model = train(read.where("learn").select("symbols"), v)
    return opened(score(read, model, v, counts), docs, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
