"""Embedding whitening by shifted CholeskyQR.

Rows become integers, x = floor(`SCALE` * c) + `OFFSET`; the fit list holds each different x once. Its rows are centred exactly
(whole part and remainder of the mean apart) and orthogonalised in passes: a pass sums the Gram matrix of the rows as the
factors so far leave them, a row at a time solved through each triangular factor, and its Cholesky factor is the next. The
first pass shifts the matrix by 11 u (n d + d (d + 1)) of its norm, so that rounding cannot make it indefinite however
ill-conditioned the rows are, and so does any later one that needs it. When the rows are orthonormal, up to directions in which
there is nothing, the product of the factors R has all of the rows' singular values, and its SVD gives the components.

What a task holds and hands over is one matrix of the dimension, added up in two steps. Sums and deviations are integers.

Defined cases: rows are left out whose vector is null, empty, holds null or non-finite entries or some x beyond 2^46, or is
not as long as most; repeated rows are whitened each, but fitted once; a null id is carried; a component without variance has
explained 0 and whitened null; a deviation that does not fit a long is null; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ._common import Scratch
from ._vectors import matrix, of_dimension, whole_vectors

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this are no integers that sums over a batch could hold.
LARGEST = 2.0**46
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
UNIT = 2.0**-53
#: How near to orthonormal the rows have to be, and from which pass on a direction without any length counts as empty.
NEAR, EMPTY, SURE, PASSES = 1e-8, 1e-12, 4, 12
#: Tasks that add up the matrices of all others.
ADDERS = 8


@dataclass(frozen=True)
class Whitening:
    """n rows were fitted; `sums` of x per dimension; `components` as columns, by falling `variances`."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    total: float
    passes: int

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and remainder of sums / n."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """The one form of a vector of integers: the narrowest of `WIDTHS` that holds them all."""
    for i, kind in enumerate(WIDTHS):
        info = np.iinfo(kind)
        if info.min <= x.min() and x.max() <= info.max:
            return bytes([i]) + x.astype(kind).tobytes()
    raise OverflowError("beyond 64 bits")


def _unpack(column: pa.Array, d: int) -> np.ndarray:
    out = np.empty((len(column), d), np.int64)
    for i, packed in enumerate(column.to_pylist()):
        out[i] = np.frombuffer(packed, WIDTHS[packed[0]], offset=1)
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part, but for their length."""
    rows = whole_vectors(embeddings, "vec_id")
    return rows.where(F.forall("vec", lambda c: F.abs(c.cast("double") * SCALE) < LARGEST))


def fit_list(rows: DataFrame, d: int, scratch: Scratch) -> DataFrame:
    """(x): each different vector of integers once, packed and without the offset, which a centred row does not see."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(x) for x in integers(matrix(b.column(0), d))], pa.binary())], names=["x"])

    return scratch.write(map_arrow(rows.select("vec"), run, "x binary").distinct(), "fit_list")


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for b in batches:
            total, n = [t + int(s) for t, s in zip(total, _unpack(b.column(0), d).sum(axis=0), strict=True)], n + b.num_rows
        if n:
            wide = pa.array([str(t) for t in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), wide, pa.array(np.full(d, n, np.int64))], names=["place", "total", "n"])

    parts = map_arrow(fit, run, "place int, total string, n long").withColumn("total", F.col("total").cast("decimal(38,0)"))
    rows = parts.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("place").collect()
    return (int(rows[0].n), [int(r.total) for r in rows]) if rows else (0, [])


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def centred(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole) - rest / n


def _gram(fit: DataFrame, model: Whitening, factors: list[np.ndarray], onto: np.ndarray | None = None) -> np.ndarray:
    """The Gram matrix of the centred rows, solved through `factors`, or of what they are in the columns of `onto`."""
    d, n, (whole, rest) = len(model.sums), model.n, model.split()
    wide = d if onto is None else onto.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((factors, onto))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, (through, columns) = np.zeros((wide, wide)), shared.value
        for b in batches:
            rows = centred(_unpack(b.column(0), d), n, whole, rest)
            for factor in through:
                rows = solve(rows, factor)
            rows = rows if columns is None else rows @ columns
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * wide)
        for b in batches:
            for m in b.column(0).to_pylist():
                total += np.frombuffer(m, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    rows = map_arrow(map_arrow(fit, run, "m binary").repartition(ADDERS), add, "m binary").collect()  # ADDERS matrices
    return sum((np.frombuffer(r.m, np.float64) for r in rows), np.zeros(wide * wide)).reshape(wide, wide)


def _settled(values: np.ndarray, passes: int) -> bool:
    """Whether all directions are orthonormal or, after enough passes to tell, empty."""
    unit, empty = np.abs(values - 1) <= NEAR, values <= EMPTY
    return bool((unit | empty).all()) and (passes >= SURE or not empty.any())


def fit(rows: DataFrame, d: int, scratch: Scratch) -> tuple[Whitening, DataFrame] | None:
    """The components of `usable` rows of dimension d, and the fit list; nothing without rows."""
    listed = fit_list(rows, d, scratch)
    n, sums = _sums(listed, d)
    if not n:
        return None
    model = Whitening(n, tuple(sums), np.eye(d), np.zeros(d), 0.0, 0)
    factors, r = [], np.eye(d)
    for passes in range(PASSES):
        g = _gram(listed, model, factors)
        size = np.trace(g)
        if not size:
            break
        values, vectors = np.linalg.eigh(g)
        if passes > 1 and _settled(values, passes):  # the shifted pass is followed by one without at least
            r = np.sqrt(np.where(values > EMPTY, values, 0))[:, None] * vectors.T @ r  # what is left of the Gram matrix counts too
            break
        shift = 0.0 if passes and values[0] > 1e-3 else 11 * UNIT * (n * d + d * (d + 1)) * size
        factor = np.linalg.cholesky(g + shift * np.eye(d)).T
        factors, r = [*factors, factor], factor @ r
    if not factors:
        r = np.zeros((d, d))
    _, singular, right = np.linalg.svd(r)
    singular[singular <= 8 * d * 2 * UNIT * singular[0]] = 0
    right *= np.where(right[np.arange(d), np.abs(right).argmax(axis=1)] < 0, -1, 1)[:, None]
    variances = singular**2 / n
    return Whitening(n, tuple(sums), right.T, variances, float(variances.sum()), len(factors)), listed


def identity_error(listed: DataFrame, model: Whitening, k: int) -> float:
    """How far the covariance of the whitened fit list is from the identity, over components with variance."""
    held = [j for j in range(k) if model.variances[j] > 0]
    if not held:
        return 0.0
    onto = model.components[:, held] / np.sqrt(model.variances[held])
    return float(np.abs(_gram(listed, model, [], onto) / model.n - np.eye(len(held))).max())


def deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n x - sum)^2 of each row; null if it is no long."""
    apart = x - whole
    if (float(np.abs(apart).max(initial=0)) + 1) ** 2 * float(n) ** 2 * x.shape[1] < 2.0**62:
        return ((apart * n - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in apart]
    return [v if v < 2**63 else None for v in exact]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each row of `embeddings` (vec_id, embedding) and each of the first components: vec_id, component, n, deviation,
    whitened, explained and identity_error."""
    rows, d = of_dimension(usable(embeddings))
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    scratch = Scratch(embeddings.sparkSession)
    fitted = fit(rows, d, scratch) if d else None
    if fitted is None:
        scratch.clear()
        return embeddings.sparkSession.createDataFrame([], schema)
    model, listed = fitted
    k = min(components, d)
    error = identity_error(listed, model, k)
    scratch.clear()
    whole, rest = model.split()
    flat = model.variances[:k] <= 0
    onto = model.components[:, :k] / np.sqrt(np.where(flat, 1.0, model.variances[:k]))
    explained = model.variances[:k] / model.total if model.total else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(matrix(b.column(1), d))
            m = len(x)
            white = centred(x, model.n, whole, rest) @ onto
            row = pa.array(np.repeat(np.arange(m), k))
            columns = [
                b.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                pa.array(deviations(x, model.n, whole, rest), pa.int64()).take(row), pa.array(white.ravel(), mask=np.tile(flat, m)),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows.select("vec_id", "vec"), run, schema)
