"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; features of the line and of its neighbours feed the
emissions, transitions tie neighbouring labels. Labels are known for documents
alone: training begins with the features of the lines themselves, each labelled
like its document. What these say of a line, and its document's label, with which
a line agrees with a chance of ``agreement``, give the chances of the line's own
label, from which all features, those of neighbours too, and the transitions are
learned. So a good document can have bad lines and the other way round. The quality of a
document is the length-weighted mean of the marginal chance that a line is good,
calibrated by a two-parameter logistic map.

Defined results: null and empty texts count as one empty line and get a score
like any other; labels that are null are ignored, of several labels of a document
the lowest counts; rows that repeat or share an id are scored one by one and all
teach; with no label at all every score is 0.5; with labels of one class only the
model learns that class; ties don't arise; an empty table gives no rows; long
texts take memory in proportion to the longest alone; extra columns are carried
along whatever their names, but one that is named like a result column gives way
to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import CARRIED, carry, opened, tidy, widened
from casegrid.llm.line_rules import NOISY, SYMBOLS

N_BASE = 14
N_FEATURES = 3 * N_BASE + 3
#: documents whose lines are scored together
SLICE = 1000


@dataclass(frozen=True)
class Settings:
    #: labelled documents that training gathers at most: its documented bound
    sample_documents: int = 4000
    #: bytes of their texts at most (as expected): fewer documents are drawn where they are long
    sample_bytes: int = 32_000_000
    #: gradient steps with every line labelled like its document, and then with the lines' own chances
    steps: int = 100
    own_steps: int = 150
    #: chance that a line has its document's label
    agreement: float = 0.7
    rate: float = 0.08
    ridge: float = 1e-3
    #: share of a document's length that a line has at least one unit of
    length_floor: float = 1.0


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_FEATURES, length of each line) over lines with a word; an empty text is one empty line."""
    data = (text or "").encode("utf-8", "surrogatepass")
    rows, sizes = [], []
    seen: set[bytes] = set()
    for line in data.split(b"\n"):
        ws = line.split()
        if not ws:
            continue
        n, size = len(ws), len(line)
        letters = line.translate(None, b" \t\x0b\x0c\r")
        upper = sum(map(letters.count, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if not letters.islower() else 0
        symbols = size - len(line.translate(None, SYMBOLS))
        digits = size - len(line.translate(None, b"0123456789"))
        stops = size - len(line.translate(None, b".,;:"))
        marks = size - len(line.translate(None, b"!?"))
        bars = ws.count(b"|")
        noisy = sum(NOISY.search(w) is not None for w in ws) if symbols or marks else 0
        stutter = sum(a == b for a, b in zip(ws, ws[1:]))
        rows.append((
            np.log1p(n) / 4, len(letters) / n / 10, min(1.0, upper / max(1, len(letters))), min(1.0, 10 * symbols / size), digits / size,
            min(1.0, 10 * stops / size), min(1.0, 10 * marks / size), bars / n, noisy / n, stutter / n,
            1 - len(set(ws)) / n, float(line in seen), float(line.rstrip()[-1:] in (b".", b"!", b"?", b'"')), float(n < 5),
        ))
        seen.add(line)
        sizes.append(size)
    if not rows:
        rows, sizes = [(0.0,) * N_BASE], [1]
    own = np.asarray(rows, dtype=np.float32)
    x = np.zeros((len(own), N_FEATURES), dtype=np.float32)
    x[:, :N_BASE] = own
    x[1:, N_BASE : 2 * N_BASE] = own[:-1]
    x[:-1, 2 * N_BASE : 3 * N_BASE] = own[1:]
    x[0, -3] = x[-1, -2] = 1.0
    x[:, -1] = 1.0
    return x, np.asarray(sizes, dtype=np.float64)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, summed pair marginals, log normaliser of each chain).

    emit: log potentials, lines x 2, chain after chain; trans: log potentials 2 x 2.
    All chains move together, longest first, so that each step is one array operation.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    alpha = np.empty(emit.shape)
    beta = np.zeros(emit.shape)
    alpha[starts] = emit[starts]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # chains that have a line at step t
    for t in range(1, longest):
        at = starts[: live[t]] + t
        before = alpha[at - 1]
        alpha[at] = emit[at] + np.logaddexp(before[:, :1] + trans[0], before[:, 1:] + trans[1])
    pairs = np.zeros((2, 2))
    log_z = np.logaddexp(*alpha[starts + sizes - 1].T)
    for t in range(longest - 1, 0, -1):
        at = starts[: live[t]] + t
        after = emit[at] + beta[at]
        beta[at - 1, 0] = np.logaddexp(trans[0, 0] + after[:, 0], trans[0, 1] + after[:, 1])
        beta[at - 1, 1] = np.logaddexp(trans[1, 0] + after[:, 0], trans[1, 1] + after[:, 1])
        joint = alpha[at - 1][:, :, None] + trans[None] + after[:, None, :] - log_z[: live[t], None, None]
        pairs += np.exp(joint).sum(axis=0)
    of_line = np.empty(len(lengths))
    of_line[order] = log_z
    both = alpha + beta - np.repeat(of_line, lengths)[:, None]
    return np.exp(both), pairs, of_line


@dataclass
class Model:
    weights: np.ndarray  # N_FEATURES, for the label good against bad
    trans: np.ndarray  # 2 x 2
    scale: float
    shift: float

    def scores(self, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        mean = self.quality(x, lengths, sizes)
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * logit(mean) + self.shift, -30, 30)))

    def quality(self, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(lengths):
            return np.empty(0)
        score = x.astype(np.float64) @ self.weights
        good = forward_backward(np.stack([-score / 2, score / 2], axis=1), lengths, self.trans)[0][:, 1]
        starts = np.cumsum(lengths) - lengths
        return np.clip(np.add.reduceat(good * sizes, starts) / np.add.reduceat(sizes, starts), 0.0, 1.0)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Adam on the conditional log likelihood, then the logistic map on document level."""
    model = Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 1.0, 0.0)
    if not len(lengths):
        return model
    y = np.repeat(labels, lengths).astype(np.float64)
    wide = x.astype(np.float64)
    inner = lengths - 1
    gold_pairs = np.diag([float(inner[labels == 0].sum()), float(inner[labels == 1].sum())])
    n = len(lengths)
    theta = np.zeros(N_FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    sure = np.log(settings.agreement / (1 - settings.agreement)) / 2
    evidence = np.stack([-(2 * y - 1) * sure, (2 * y - 1) * sure], axis=1)
    for step in range(1, settings.steps + settings.own_steps + 1):
        score = wide @ theta[:-4]
        emit, trans = np.stack([-score / 2, score / 2], axis=1), theta[-4:].reshape(2, 2)
        good, pairs, _ = forward_backward(emit, lengths, trans)
        if step == settings.steps + 1:  # what the lines are, given their own features and the document's label
            clamped, gold_pairs, _ = forward_backward(emit + evidence, lengths, trans)
            y = clamped[:, 1]
        grad = np.concatenate([wide.T @ (y - good[:, 1]), (gold_pairs - pairs).ravel()]) / n - settings.ridge * theta
        if step <= settings.steps:  # neighbours and transitions would explain a line's label by its document
            grad[N_BASE : 3 * N_BASE] = grad[-4:] = 0.0
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta += settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model = Model(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy(), 1.0, 0.0)
    z = logit(model.quality(x, lengths, sizes))
    a, b = 1.0, 0.0
    for _ in range(200):  # damped Newton steps of the two-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((labels - p) * z).sum() - 0.01 * a, (labels - p).sum()])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a + 0.5 * move[0], b + 0.5 * move[1]
    return Model(model.weights, model.trans, float(a), float(b))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a bounded sample of labelled documents; ``labels`` (doc_id, quality) holds training rows only.

    Sampled ids (at most about ``sample_documents``) go to every task; features
    of all lines of these documents, not texts, come back.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    total = known.count()
    if not total:
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 1.0, 0.0)
    share = min(1.0, settings.sample_documents / total)

    def labelled_rows(share: float) -> DataFrame:
        most = int(share * 2**32)
        taken = known.where(F.crc32(F.concat_ws(":", F.lit("crf"), F.col("doc_id").cast("string")).cast("binary")) < most)
        return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id").select("label", "text")

    rows = labelled_rows(share)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > settings.sample_bytes:
        rows = labelled_rows(share * settings.sample_bytes / size)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                x, sizes = line_features(text.as_py())
                out.append((label, len(x), x.tobytes(), sizes.tobytes()))
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["label", "n", "x", "sizes"])

    got = sorted(rows.mapInArrow(tidy(extract), "label int, n int, x binary, sizes binary").collect(), key=lambda r: (r["label"], bytes(r["x"])))
    if not got:
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 1.0, 0.0)
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in got])
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.float64) for r in got])
    return fit(x, np.array([r["n"] for r in got]), sizes, np.array([r["label"] for r in got]), settings)


def score(docs: DataFrame, model: Model, with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (text only ``with_text``), then quality_score. One narrow pass, no shuffle."""
    rows = carry(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for at in range(0, len(batch), SLICE):  # features of some documents at a time
                got = [line_features(t.as_py()) for t in batch.column(1).slice(at, SLICE)]
                lengths = np.array([len(s) for _, s in got])
                parts.append(model.scores(np.concatenate([x for x, _ in got]), lengths, np.concatenate([s for _, s in got])))
            out = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + with_text], pa.array(out, pa.float64())], [CARRIED, *["text"] * with_text, "quality_score"])

    made = rows.mapInArrow(tidy(run), widened(rows, () if with_text else ("text",), "quality_score double"))
    return opened(made, docs, [*["text"] * with_text, "quality_score"])
