"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, and context windows.

``learn`` finds the lexicon in labelled documents: words, and stems of several words,
that occur in toxic documents far more than in others (a likelihood ratio above what
chance gives one word of the vocabulary). A word counts no more often than it has
different neighbours on either side, so that words of one passage that is copied around
aren't terms. Words close to a term that
clean documents use are spelt right, not misspelt terms, and are set apart.

``score`` looks each different word up once: by itself, by its stem, or by a
Levenshtein automaton (one error from four letters, two from nine) that runs down the
trie of terms. Each hit has a window: quotation marks around it on its line, a line that
quotes, and words of reporting or naming near it, less words that address someone,
say how much of the hit's weight is quotation and how much abuse. The masses of
both, of misspelt hits, and the share of hits are the features of a logistic model,
fitted to the labelled documents around a prior that rules where they say nothing.

Bounds (parameters): ``sample_documents`` labelled documents of each class teach,
drawn by the smallest hashes of their ids; the lexicon has up to ``terms`` terms.
Scoring covers all documents in one narrow pass.

Defined results: null and empty texts have no hits and get the model's lowest
score; labels that are null are ignored, of several labels of a document the
highest counts; label rows without doc_id have no document; rows that repeat are
scored one by one; without any toxic label there is no lexicon, and every score is
the prior's of a text without hits (about 0.05); ties of candidates go by the word;
an empty table gives no rows; long texts take memory in proportion to the longest
alone; extra columns are carried along whatever their names, but one that is named
like a result column gives way to it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import CARRIED, carry, forget, opened, stored, tidy, widened

#: Words that report or name speech, and words that address someone, in four languages.
REPORTING = frozenset(
    "said says saying wrote writes called calling quote quoted quoting word words term terms phrase slur insult means meaning definition "
    "dit écrit appelé mot mots terme citation insulte signifie sagte schrieb nannte wort wörter begriff zitat beleidigung bedeutet "
    "dijo escribió llamó palabra palabras término cita insulto significa".split()
)
ADDRESSING = frozenset("you your you're youre tu toi vous ton votre du dein deine ihr sie tú usted vosotros eres".split())
#: Marks that open a quotation, each with the one that closes it.
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‹", "›"))
QUOTE_MARKS = frozenset("".join(a + b for a, b in QUOTES))
#: Fixed value: characters that are no part of a word at its ends.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»‹›“”„‘’…¡¿·•0123456789"

N_FEATURES = 5


@dataclass(frozen=True)
class Settings:
    #: labelled documents of each class that teach at most
    sample_documents: int = 10_000
    #: terms of the lexicon at most
    terms: int = 2_000
    #: candidates whose contexts are looked at, at most
    candidates: int = 20_000
    #: words close to a term that are known to be others, at most
    innocents: int = 100_000
    min_documents: int = 3
    #: letters of a stem, words that share it at least, and share of its count that one of them may have
    stem_letters: tuple[int, int] = (4, 9)
    stem_words: int = 3
    stem_share: float = 0.6
    #: what a likelihood ratio must have above twice the logarithm of the vocabulary
    margin: float = 4.0
    #: times that a word must be likelier in toxic documents
    min_ratio: float = 8.0
    longest_word: int = 40
    #: words of a window on each side
    window: int = 6
    #: share of a term's weight that it keeps with each error
    misspelt: float = 0.8
    #: prior of the features' weights, and its strength
    prior: tuple[float, ...] = (-3.0, 2.0, 0.0, -0.5, 1.0)
    strength: float = 2.0


def core(word: str) -> str:
    """A word without case and without marks and digits at its ends."""
    return word.lower().strip(EDGES)


def joined(word: str) -> str:
    """The letters of a word alone (``i.d.i.o.t``)."""
    return "".join(filter(str.isalpha, word))


# --- Levenshtein automata over a trie -------------------------------------------------


class Automaton:
    """Levenshtein automaton of k errors for every word: its states are made when first met.

    A state is the set of positions (offset, errors) in the word, relative to the
    smallest; a step depends on where the next 2k+1 letters of the word equal the
    letter read, and on how many letters are left, so steps are remembered for all words.
    """

    def __init__(self, errors: int):
        self.errors = errors
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.steps: dict[tuple[int, int, int], tuple[int, int] | None] = {}
        self.start = self._numbered({(0, 0)})[1]

    def _numbered(self, positions: set[tuple[int, int]]) -> tuple[int, int]:
        """(smallest offset, number of the state) after positions that another one implies are left out."""
        kept = sorted((i, e) for i, e in positions if not any(f < e and abs(j - i) <= e - f for j, f in positions))
        base = kept[0][0]
        state = tuple((i - base, e) for i, e in kept)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return base, self.number[state]

    def step(self, state: int, equal: int, left: int) -> tuple[int, int] | None:
        """(letters moved on, next state), or None; ``equal``: bit j set where the word's letter at base + j is the one read."""
        key = (state, equal, left)
        if key in self.steps:
            return self.steps[key]
        after = set()
        for i, e in self.states[state]:
            if i < left and equal >> i & 1:
                after.add((i + 1, e))
                continue
            if e < self.errors:
                after.add((i, e + 1))  # the term has a letter more
                if i < left:
                    after.add((i + 1, e + 1))  # another letter
            for skip in range(1, self.errors - e + 1):  # the word has letters more
                if i + skip < left and equal >> (i + skip) & 1:
                    after.add((i + skip + 1, e + skip))
                    break
        self.steps[key] = self._numbered(after) if after else None
        return self.steps[key]

    def distance(self, state: int, left: int) -> int | None:
        """Errors in all if the term ends here with ``left`` letters of the word to come."""
        return min((e + left - i for i, e in self.states[state] if e + left - i <= self.errors), default=None)


class Trie:
    """Terms by letters; a node is [children, term or None, errors that some term below allows]."""

    def __init__(self, terms: list[str]):
        self.root: list = [{}, None, 0]
        for term in terms:
            node = self.root
            node[2] = max(node[2], allowed(term))
            for letter in term:
                node = node[0].setdefault(letter, [{}, None, 0])
                node[2] = max(node[2], allowed(term))
            node[1] = term


def allowed(term: str) -> int:
    """Errors that a term may have."""
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


AUTOMATA = {errors: Automaton(errors) for errors in (1, 2)}


def nearest(word: str, trie: Trie) -> tuple[int, str] | None:
    """(distance, term) of the nearest term within the errors that it allows; of equally near ones the first by letters."""
    places: dict[str, int] = {}
    for i, letter in enumerate(word):
        places[letter] = places.get(letter, 0) | 1 << i
    best: tuple[int, str] | None = None
    for errors, automaton in AUTOMATA.items():
        width = 2 * errors + 1
        todo = [(trie.root, 0, automaton.start)]
        while todo:
            node, base, state = todo.pop()
            if node[1] is not None and allowed(node[1]) == errors:
                far = automaton.distance(state, len(word) - base)
                if far is not None and (best is None or (far, node[1]) < best):
                    best = far, node[1]
            left = min(width, len(word) - base)
            for letter, below in node[0].items():
                if below[2] >= errors:
                    moved = automaton.step(state, places.get(letter, 0) >> base & ((1 << left) - 1), left)
                    if moved is not None:
                        todo.append((below, base + moved[0], moved[1]))
    return best


class Lookup:
    """Hits by word, in bounded memory. ``stems`` are terms that any ending may follow; they know no errors."""

    def __init__(self, weights: dict[str, float], stems: dict[str, float], innocents: dict[str, int], remember: int = 300_000):
        self.weights, self.stems, self.innocents, self.remember = weights, stems, innocents, remember
        self.stem_sizes = sorted({len(t) for t in stems})
        self.trie = Trie(sorted(weights))
        # an exact test that spares most words the automaton: cut a term into one part more than it may have errors; then one part is in the
        # word as it is, at its beginning, at its end or (of three parts, the middle one) anywhere. By length of word:
        parts: dict[int, tuple[set[str], set[str], set[str]]] = {}
        for term in weights:
            errors, n = allowed(term), len(term)
            if errors:
                first, last = n // (errors + 1), n - n // (errors + 1)
                for size in range(n - errors, n + errors + 1):
                    of_size = parts.setdefault(size, (set(), set(), set()))
                    of_size[0].add(term[:first])
                    of_size[1].add(term[first if errors == 1 else last :])
                    if errors == 2:
                        of_size[2].add(term[first:last])
        self.parts = {size: (tuple(a), tuple(b), tuple(c)) for size, (a, b, c) in parts.items()}
        self.known: dict[bytes, tuple[str, int] | None] = {}

    def of(self, raw: bytes) -> tuple[str, int] | None:
        """(term, distance) of a word as it stands in a text."""
        try:
            return self.known[raw]
        except KeyError:
            pass
        if len(self.known) >= self.remember:
            self.known.clear()
        got = self.known[raw] = self.find(core(raw.decode("utf-8", "replace")))
        return got

    def find(self, word: str) -> tuple[str, int] | None:
        if word in self.weights:
            return word, 0
        for size in self.stem_sizes:
            if word[:size] in self.stems:
                return word[:size], 0
        if len(word) < 3 or not self.weights:
            return None
        letters = word if word.isalpha() else joined(word)
        if letters != word and letters in self.weights:
            return letters, 1
        starts, ends, middles = self.parts.get(len(word), ((), (), ()))
        if not (word.startswith(starts) or word.endswith(ends) or any(m in word for m in middles)) or word in self.innocents:
            return None
        got = nearest(word, self.trie)
        return (got[1], got[0]) if got else None


# --- context windows ------------------------------------------------------------------


def quoted(line: str, at: int, reach: int = 400) -> bool:
    """Is the place inside a pair of quotation marks of its line, not more than ``reach`` characters away?"""
    before, after = line[max(0, at - reach) : at], line[at : at + reach]
    for start, end in QUOTES:
        open_here = before.count(start) % 2 == 1 if start == end else before.rfind(start) > before.rfind(end)
        if open_here and end in after:
            return True
    return False


def quotation_share(line: str, ws: list[str], places: list[int], k: int, window: int) -> float:
    """Share of a hit (the k-th word of the line) that is quotation."""
    own = ws[k]
    inside = len(own) - len(own.strip("".join(QUOTE_MARKS)))
    share = 0.6 * (inside >= 2 or quoted(line, places[k]) or quoted(line, places[k] + len(own) // 2) or line.lstrip()[:1] == ">")
    near = [core(w) for w in ws[max(0, k - window) : k] + ws[k + 1 : k + 1 + window]]
    share += 0.35 * any(w in REPORTING for w in near)
    share -= 0.25 * any(w in ADDRESSING for w in near)
    return min(1.0, max(0.0, share))


def features(text: bytes, lookup: Lookup, settings: Settings) -> np.ndarray:
    """Constant, mass of abuse, of its misspelt part, mass of quotation, share of hits among the words."""
    out = np.array([1.0, 0.0, 0.0, 0.0, 0.0])
    ws = text.split()
    of = lookup.of
    hits = {w for w in set(ws) if of(w) is not None}
    if not hits:
        return out
    abuse = misspelt = quotation = 0.0
    n = 0
    for raw in text.split(b"\n"):
        tokens = raw.split()
        if hits.isdisjoint(tokens):
            continue
        line = raw.decode("utf-8", "replace")
        words = [t.decode("utf-8", "replace") for t in tokens]
        places, at = [], 0
        for w in words:
            at = max(at, line.find(w, at))
            places.append(at)
            at += len(w)
        for k, t in enumerate(tokens):
            if t in hits:
                term, far = of(t)
                weight = (lookup.weights.get(term) or lookup.stems[term]) * settings.misspelt**far
                share = quotation_share(line, words, places, k, settings.window)
                abuse += weight * (1 - share)
                misspelt += weight * (1 - share) * (far > 0)
                quotation += weight * share
                n += 1
    out[1:] = np.log1p(abuse), np.log1p(misspelt), np.log1p(quotation), np.sqrt(n / len(ws))
    return out


# --- learning -------------------------------------------------------------------------


@dataclass
class Model:
    settings: Settings
    weights: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    innocents: dict[str, int] = field(default_factory=dict)
    theta: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        theta = np.array(self.settings.prior) if self.theta is None else self.theta
        return 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, settings: Settings) -> np.ndarray:
    """Newton steps on the log likelihood, with a quadratic pull to the prior."""
    prior = np.array(settings.prior)
    theta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (y - p) - settings.strength * (theta - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + settings.strength * np.eye(len(prior))
        move = np.linalg.solve(hess, grad)
        theta = theta + move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-8:
            break
    theta[1] = max(theta[1], 0.1)  # more abuse is never less toxic
    return theta


def sampled(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(toxic, text) of the labelled documents of each class with the smallest hashes of their ids; ids are broadcast, texts don't move."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_documents) for c in (0, 1)]
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("toxic", "text")


def word_counts(sample: DataFrame, settings: Settings) -> DataFrame:
    """(word, toxic, clean): documents of each class that hold a word; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def sent() -> pa.RecordBatch:
            words = list(set(counts[0]) | set(counts[1]))
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([counts[c][w] for w in words], pa.int64()) for c in (1, 0))], ["word", "toxic", "clean"])
            counts[0].clear()
            counts[1].clear()
            return made

        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = {core(w.decode("utf-8", "replace")) for w in set((text.as_py() or b"").split())}
                counts[toxic].update(w for w in words if 0 < len(w) <= settings.longest_word)
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield sent()
        yield sent()

    return sample.mapInArrow(tidy(run), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def context_counts(sample: DataFrame, words: set[str], stems: set[str]) -> dict[str, int]:
    """Different neighbours that each word or stem has in toxic documents, on the side where they are fewer."""
    sizes = sorted({len(t) for t in stems})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(1):
                ws = (text.as_py() or b"").split()
                for k, w in enumerate(core(w.decode("utf-8", "replace")) for w in ws):
                    of = {w[:n] for n in sizes if w[:n] in stems} | {w} & words
                    if of:
                        sides = [(s, zlib.crc32(b"".join(ws[max(0, k + s) : k + s + 1]))) for s in (-1, 1)]
                        found.update((t, *side) for t in of for side in sides)
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["word", "side", "neighbour"])

    pairs = sample.where("toxic = 1").mapInArrow(tidy(run), "word string, side int, neighbour long").distinct()
    sides = pairs.groupBy("word").agg(*[F.count_if(F.col("side") == s).alias(name) for s, name in ((-1, "before"), (1, "after"))])
    return {r["word"]: min(r["before"], r["after"]) for r in sides.collect()}


def surprise(toxic: float, clean: float, share: float) -> float:
    """Likelihood ratio of counts against the share of toxic documents."""
    seen = toxic + clean
    return 2 * sum(k * math.log(k / (seen * q)) for k, q in ((toxic, share), (clean, 1 - share)) if k > 0)


def marked(counts: DataFrame, totals: dict[int, int], least: float, settings: Settings) -> list:
    """(word, toxic, clean, weight) of the words or stems that mark toxic documents, the strongest first."""
    t, c = F.col("toxic"), F.col("clean")
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    share = F.lit(n1 / (n1 + n0))
    seen = t + c
    xlogx = lambda k, q: F.when(k > 0, k * F.log(k / q)).otherwise(0.0)
    ratio = 2 * (xlogx(t, seen * share) + xlogx(c, seen * (1 - share)))
    weight = F.log((t + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))
    found = counts.where((t >= settings.min_documents) & (ratio >= least)).select("word", "toxic", "clean", weight.alias("weight")).where(F.col("weight") >= float(np.log(settings.min_ratio)))
    return found.orderBy(F.desc(F.col("toxic") * F.col("weight")), "word").limit(settings.candidates).collect()


def lexicon(counts: DataFrame, sample: DataFrame, totals: dict[int, int], settings: Settings) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) and their weights: the log ratio of the smoothed shares of toxic and clean documents that hold them."""
    least = 2 * float(np.log(max(2, counts.count()))) + settings.margin
    shortest, longest = settings.stem_letters
    ends = F.expr(f"transform(sequence({shortest}, least(length(word) - 1, {longest})), n -> left(word, n))")
    families = counts.where(F.length("word") > shortest).select(F.explode(ends).alias("word"), "toxic", "clean").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("members"), F.max("toxic").alias("largest")
    )
    families = families.where((F.col("members") >= settings.stem_words) & (F.col("largest") <= settings.stem_share * F.col("toxic")))
    rows = [(r, False) for r in marked(counts, totals, least, settings)] + [(r, True) for r in marked(families, totals, least, settings)]
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    words, stems = {r["word"] for r, stem in rows if not stem}, {r["word"] for r, stem in rows if stem}
    contexts = context_counts(sample, words, stems) if rows else {}
    held: tuple[dict[str, float], dict[str, float]] = {}, {}
    prefixes: set[str] = set()  # of stems that are held
    for r, stem in sorted(rows, key=lambda x: (-x[0]["toxic"] * x[0]["weight"], x[0]["word"], x[1])):
        word = r["word"]
        covered = any(word[:n] in held[1] for n in range(shortest, len(word) + 1)) or (stem and word in prefixes)
        seen = min(contexts.get(word, 0), r["toxic"])
        telling = seen >= settings.min_documents and surprise(seen, r["clean"], share) >= least
        if telling and not covered and len(held[0]) + len(held[1]) < settings.terms:
            held[stem][word] = float(r["weight"])
            if stem:
                prefixes.update(word[:n] for n in range(shortest, len(word)))
    return held


def innocents(counts: DataFrame, weights: dict[str, float], stems: dict[str, float], settings: Settings) -> dict[str, int]:
    """Words of clean documents that are within reach of a term without being one: their number of clean documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(weights, stems, {})
        for batch in batches:
            near = [(lookup.find(w) or (w, 0))[1] > 0 for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(near, pa.bool_()))

    rows = counts.where("clean > 0").select("word", "clean").mapInArrow(tidy(run), "word string, clean long")
    return {r["word"]: r["clean"] for r in rows.orderBy(F.desc("clean"), "word").limit(settings.innocents).collect()}


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on labelled documents; ``labels`` (doc_id, toxic) holds training rows only."""
    model = Model(settings)
    sample = stored(sampled(docs, labels, settings), docs.sparkSession, "toxicity-sample", block_size=16_000_000)
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if totals.get(1):
        counts = stored(word_counts(sample, settings), docs.sparkSession, "toxicity-words")
        weights, stems = lexicon(counts, sample, totals, settings)
        known = innocents(counts, weights, stems, settings) if weights else {}
        forget(counts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a word that only one clean document uses isn't known to be spelt right while that document is looked at
            of_class = [Lookup(weights, stems, {w: c for w, c in known.items() if c > 1}), Lookup(weights, stems, known)]
            for batch in batches:
                rows = [(toxic, features(text.as_py() or b"", of_class[toxic], settings).tobytes()) for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1))]
                columns = list(zip(*rows)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary())], ["toxic", "x"])

        rows = sorted((r["toxic"], bytes(r["x"])) for r in sample.mapInArrow(tidy(run), "toxic int, x binary").collect())
        x = np.stack([np.frombuffer(v) for _, v in rows])
        model = Model(settings, weights, stems, known, fit_logistic(x, np.array([t for t, _ in rows], dtype=float), settings))
    forget(sample)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but text, then toxicity. One narrow pass, no shuffle; the model is a few MB at most."""
    rows = carry(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model.weights, model.stems, model.innocents)
        for batch in batches:
            x = [features((t.as_py() or "").encode("utf-8", "surrogatepass"), lookup, model.settings) for t in batch.column(1)]
            got = model.scores(np.stack(x)) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], [CARRIED, "toxicity"])

    return opened(rows.mapInArrow(tidy(run), widened(rows, ("text",), "toxicity double")), docs, ["toxicity"])
