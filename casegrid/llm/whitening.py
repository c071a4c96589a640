"""Whitening of embeddings: compensated covariance and a tridiagonal divide-and-conquer eigen-solve.

Entries become integers, ``floor(scale * c)``; an origin added to all of them would
change no result. The fit list holds each different integer vector once. Its sums are exact. Its covariance is a sum of
outer products of centred vectors ``n*x - S`` (integers, so centring is exact):
a block of rows is split into slices of 20 bits whose products and sums over a
block no double rounds (an error-free transformation of the matrix product), and
blocks are added in double-double arithmetic. Tasks send the high and the low
part, which are merged in double-double too, ``MERGE`` partials at a time.

The matrix, a few thousand numbers whatever the input, is solved by LAPACK's
``syevd`` (``numpy.linalg.eigh``): reduction to tridiagonal form, then divide and
conquer. Rows are projected in one narrow pass. ``identity_error`` is measured: a
pass over the fit list sums the whitened vectors' own outer products.

Defined results: rows whose vector is null, empty or has a null, infinite or NaN
entry, or one of 2**31 / scale or more in size, are dropped; so are rows whose
length differs from the most frequent length of the fit list (of equally frequent
ones the longest). Repeated rows are all returned, and count once in the fit. A
null id is kept. Directions without variance (below 1e-12 of the largest) can't be
whitened and have no rows, so a table whose vectors are all equal, or an empty
one, gives no rows. Of equal eigenvalues the solver's order decides. ``deviation``
is null where it exceeds 64 bits. Columns other than id and vector are ignored,
whatever their names. Memory: one Arrow batch and the matrix in each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrid.llm.common import forget, stored, tidy

#: bits of a slice and rows of a block: products of two slices summed over a block stay below 2**53
SLICE_BITS, BLOCK = 20, 2048
#: partial matrices that one task merges
MERGE = 64
#: bytes of partial matrices that the driver merges at the end
LAST_BYTES = 16_000_000


@dataclass(frozen=True)
class Settings:
    scale: int = 64
    components: int = 16
    #: share of the largest eigenvalue below which a direction has no variance
    flat: float = 1e-12


def vectors(column: pa.Array, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as integers) for each length of vector in a batch."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    usable = np.asarray(column.is_valid()) & (sizes > 0)
    for size in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == size))
        with np.errstate(invalid="ignore", over="ignore"):
            whole = np.floor(settings.scale * values[offsets[rows][:, None] + np.arange(size)])
            good = (np.abs(whole) < 2**31).all(axis=1)  # False for NaN and infinite entries too
        if good.any():
            yield rows[good], whole[good].astype(np.int64)


def packed(whole: np.ndarray) -> list[bytes]:
    """Each vector as its narrowest integers, after the width in one byte: equal vectors give equal bytes."""
    most = np.maximum(whole.max(axis=1), -1 - whole.min(axis=1))
    width = np.where(most < 2**7, 1, np.where(most < 2**15, 2, 4))
    out: list[bytes] = [b""] * len(whole)
    for w in (1, 2, 4):
        at = np.flatnonzero(width == w)
        data, step = whole[at].astype(f"<i{w}").tobytes(), w * whole.shape[1]
        for k, row in enumerate(at.tolist()):
            out[row] = bytes([w]) + data[k * step : (k + 1) * step]
    return out


def unpacked(codes: pa.Array, dims: int) -> np.ndarray:
    """The vectors of one length again."""
    return np.stack([np.frombuffer(c, f"<i{c[0]}", dims, 1).astype(np.int64) for c in codes.to_pylist()]) if len(codes) else np.empty((0, dims), np.int64)


def fit_list(rows: DataFrame, settings: Settings) -> DataFrame:
    """(code, dims): each different vector once. Copies meet inside tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, whole in vectors(batch.column(0), settings):
                yield pa.RecordBatch.from_arrays([pa.array(packed(whole), pa.binary()), pa.array([whole.shape[1]] * len(whole), pa.int32())], ["code", "dims"])

    return rows.select("vector").mapInArrow(tidy(run), "code binary, dims int").groupBy("code").agg(F.min("dims").alias("dims"))


@dataclass(frozen=True)
class Centre:
    """n vectors with sums S = n * whole + rest in each dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def numerators(self, vectors: np.ndarray) -> np.ndarray:
        """n*x - S: 64-bit integers, or Python's where those could overflow."""
        moved = vectors - self.whole
        if len(moved) and self.n * (int(np.abs(moved).max()) + 1) >= 2**62:
            return self.n * moved.astype(object) - self.rest.astype(object)
        return self.n * moved - self.rest


def centre(fit: DataFrame, dims: int) -> Centre:
    """Exact sums: whole numbers in tasks, decimals across them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=object)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):  # a block of 2**31 stays far below 2**63
                block = unpacked(batch.column(0).slice(at, BLOCK), dims)
                n, total = n + len(block), total + block.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1), pa.int32()), pa.array([*map(str, total), str(n)])], ["dim", "total"])

    sums = fit.select("code").mapInArrow(tidy(run), "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    got = {r["dim"]: int(r["total"]) for r in sums.collect()}
    n = got[dims]
    whole = [(2 * got[k] + n) // (2 * n) for k in range(dims)]
    return Centre(n, np.array(whole, dtype=np.int64), np.array([got[k] - n * w for k, w in enumerate(whole)], dtype=np.int64))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(high: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum of (high, low) and (more, more_low)."""
    s, e = two_sum(high, more)
    e = e + (low + more_low)
    top = s + e
    return top, e - (top - s)


def slices(values: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(doubles below 2**SLICE_BITS in size, their unit): integers cut into slices that add up to them."""
    unit = 1
    while values.any():
        high = (values + (1 << (SLICE_BITS - 1))) >> SLICE_BITS
        yield (values - (high << SLICE_BITS)).astype(np.float64), float(unit)
        values, unit = high, unit << SLICE_BITS


def outer_sums(blocks: Iterator[np.ndarray], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum of the outer products of all rows of integer blocks."""
    high, low = np.zeros((dims, dims)), np.zeros((dims, dims))
    for block in blocks:
        parts = list(slices(block))
        for a, ua in parts:
            for b, ub in parts:
                high, low = dd_add(high, low, (a.T @ b) * (ua * ub))  # an exact product by a power of two
    return high, low


PARTIAL = "part long, high binary, low binary"


def partial(part: int, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())], ["part", "high", "low"])


def merged_matrix(partials: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of partial matrices, ``MERGE`` to a task until the driver can take the rest."""

    def add(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.zeros(dims * dims), np.zeros(dims * dims)
        for h, l in rows:  # noqa: E741
            high, low = dd_add(high, low, np.frombuffer(h), np.frombuffer(l))
        return high, low

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        return pa.Table.from_batches([partial(key[0].as_py(), *add(list(zip(table.column("high").to_pylist(), table.column("low").to_pylist()))))])

    spark = partials.sparkSession
    level = stored(partials, spark, "whitening-sums")
    while level.count() > max(1, LAST_BYTES // (16 * dims * dims)):
        above = stored(level.withColumn("group", F.floor(F.col("part") / MERGE).cast("long")).groupBy("group").applyInArrow(merge, PARTIAL), spark, "whitening-sums")
        forget(level)
        level = above
    rows = sorted(level.collect(), key=lambda r: r["part"])
    forget(level)
    high, low = add([(r["high"], r["low"]) for r in rows])
    return high.reshape(dims, dims), low.reshape(dims, dims)


def covariance(fit: DataFrame, middle: Centre) -> np.ndarray:
    """Covariance (divisor n) of the fit list, rounded once to doubles."""
    dims = len(middle.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for batch in batches:
                for at in range(0, len(batch), BLOCK):
                    yield middle.numerators(unpacked(batch.column(0).slice(at, BLOCK), dims))

        yield partial(TaskContext.get().partitionId(), *outer_sums(blocks(), dims))

    high, low = merged_matrix(fit.select("code").mapInArrow(tidy(run), PARTIAL), dims)
    v = high / float(middle.n) ** 3 + low / float(middle.n) ** 3
    return (v + v.T) / 2


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    #: dims x components: unit eigenvectors over the roots of their eigenvalues
    project: np.ndarray
    #: share of the trace of each component
    explained: np.ndarray

    def apply(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numerators n*x - S, whitened vectors)."""
        top = self.centre.numerators(whole)
        return top, (top.astype(np.float64) / self.centre.n) @ self.project


def solve(middle: Centre, v: np.ndarray, settings: Settings) -> Whitening:
    values, basis = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[: settings.components]
    values, basis = values[order], basis[:, order]
    held = values > max(settings.flat * values[:1].max(initial=0.0), 0.0)
    values, basis = values[held], basis[:, held]
    return Whitening(middle, basis / np.sqrt(values), values / np.trace(v))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from a pass over the list."""
    dims, k = model.project.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                y = model.apply(unpacked(batch.column(0).slice(at, BLOCK), dims))[1]
                high, low = dd_add(high, low, y.T @ y)
        yield partial(TaskContext.get().partitionId(), high, low)

    high, low = merged_matrix(fit.select("code").mapInArrow(tidy(run), PARTIAL), k)
    return float(np.abs((high + low) / model.centre.n - np.eye(k)).max(initial=0.0))


SCHEMA = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def deviations(top: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None above 64 bits."""
    if len(top) and top.dtype != object and int(np.abs(top).max()) ** 2 * top.shape[1] < 2**63:
        return (top * top).sum(axis=1).tolist()
    sums = (top.astype(object) ** 2).sum(axis=1)
    return [int(s) if s < 2**63 else None for s in sums]


def whiten(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each usable vector and component.

    The fit list is written once to the shared folder and read three times; the
    vectors themselves never move.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    schema = SCHEMA.format(kind=dict(rows.dtypes)["vec_id"])
    every = stored(fit_list(rows, settings), spark, "whitening-fit")
    length = every.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if length is None:
        forget(every)
        return spark.createDataFrame([], schema)
    dims = length["dims"]
    fit = every.where(F.col("dims") == dims)
    middle = centre(fit, dims)
    model = solve(middle, covariance(fit, middle), settings)
    error = identity_error(fit, model) if model.project.shape[1] else 0.0
    forget(every)
    k = model.project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, whole in vectors(batch.column(1), settings):
                if whole.shape[1] != dims or not k:
                    continue
                top, out = model.apply(whole)
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, middle.n), pa.int64()),
                        pa.array(deviations(top), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(out.ravel(), pa.float64()),
                        pa.array(np.tile(model.explained, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(tidy(run), schema)
