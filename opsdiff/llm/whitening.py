"""Embedding whitening: QDWH spectral divide-and-conquer of the covariance, then one pass over the rows.

Sums and products over all vectors are made by the executors; the driver gets one number a
dimension and one a pair of dimensions, whatever the number of rows.  There the covariance is
split: the polar factor of the matrix less a shift, by QR-based dynamically weighted Halley
steps, is 1 on the invariant subspace of the eigenvalues above the shift and -1 below; half
of it plus half the identity is the spectral projector, whose range and complement give two
smaller matrices.  Only halves that can hold one of the wanted components are split further.
Mean and components travel to the rows in the tasks' closure: dims * (components + 1) numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsdiff.llm.vectors import dimensions, finite

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0**61  # a scaled entry beyond is taken for this
LEAST_SHARE = 1e-11  # of the greatest eigenvalue; below, the covariance has no component
_EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH with QR decompositions."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))  # at most the smallest singular value
    except np.linalg.LinAlgError:
        low = _EPS
    low = float(np.clip(low, _EPS, 1.0))
    for _ in range(20):
        before = x
        g = np.cbrt(4 * max(0.0, 1 - low * low) / low**4)
        root = np.sqrt(1 + g)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * g + 8 * (2 - low * low) / (low * low * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if abs(1 - low) < 10 * _EPS and np.linalg.norm(x - before) < np.cbrt(4 * _EPS):
            break
    return x


def split(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the subspaces above and below a shift; None if all eigenvalues are equal.

    size is the norm of the whole matrix.  The mean of the eigenvalues lies among them, so that
    it parts them unless it is one itself; then some other shift does.
    """
    n = len(a)
    diagonal = np.sort(np.diag(a))
    mean, spread = np.trace(a) / n, np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * n * _EPS * size:
        return None
    best = None
    for shift in (mean, mean + spread / 7, mean - spread / 7, diagonal[n // 2], mean + spread / 3, mean - spread / 3):
        h = a - shift * np.eye(n)
        projector = (np.eye(n) + polar(h)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        start = np.random.default_rng(n).standard_normal((n, k))
        for _ in range(2):
            q, _ = np.linalg.qr(projector @ start, mode="complete")
            start = q[:, :k]
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = left, q[:, :k], q[:, k:]
        if left <= 10 * n * _EPS * size:
            break
    return best and best[1:]


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns): the greatest eigenvalues of a symmetric matrix, falling."""
    size = float(np.linalg.norm(a))
    found: list[np.ndarray] = []
    rest = [np.eye(len(a))]  # bases still to be split, the one with the greatest eigenvalues last
    while rest and len(found) < wanted:
        basis = rest.pop()
        inside = basis.T @ a @ basis
        halves = split((inside + inside.T) / 2, size) if basis.shape[1] > 1 else None
        if halves is None:
            found.extend(basis.T)
        else:
            rest += [basis @ halves[1], basis @ halves[0]]
    # Products of many bases leave orthogonality by a few units in the last place.
    vectors, _ = np.linalg.qr(np.array(found[:max(wanted, 0)]).T) if found else (np.zeros((len(a), 0)), None)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The long x of each entry."""
    return np.clip(np.floor(SCALE * vectors), -LARGEST, LARGEST).astype(np.int64) + OFFSET


@dataclass
class Whitening:
    """Everything a row needs, and what was measured over all rows."""

    dims: int
    rows: int
    middle: np.ndarray      # whole number next to each mean
    rest: list[int]         # S - n * middle
    offset: np.ndarray      # the same over n
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.offset) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)**2 of each row, exact; None where that is no long."""
        n, y = self.rows, x - self.middle
        own = sum(r * r for r in self.rest)
        most = int(np.abs(y).max(initial=0))
        if self.dims * most * max(most, max(map(abs, self.rest), default=0)) < 2**62:
            squares, cross = (y * y).sum(axis=1).tolist(), (y @ np.array(self.rest, np.int64)).tolist()
        else:
            wide = y.astype(object)
            squares, cross = (wide * wide).sum(axis=1).tolist(), (wide @ np.array(self.rest, object)).tolist()
        sums = (n * n * s - 2 * n * c + own for s, c in zip(squares, cross, strict=True))
        return [s if s < 2**63 else None for s in sums]


def summed(rows: DataFrame, dims: int, per_batch: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sums over all vectors of an array that per_batch makes: added up in each task, then by Spark."""
    exact = kind == "long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, vectors = finite(batch.column(0), dims)
            if len(vectors):
                part = per_batch(scaled(vectors)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch({"part": pa.array([total.tolist()], pa.list_(pa.int64() if exact else pa.float64()))})

    parts = rows.mapInArrow(task, f"part array<{kind}>").select(F.posexplode("part").alias("at", "x"))
    value = F.col("x").cast("decimal(38,0)") if exact else F.col("x")
    got = parts.groupBy("at").agg(F.sum(value).alias("x")).orderBy("at").toArrow()["x"].to_pylist()
    return np.array([int(x) for x in got], object) if exact else np.array(got, float)


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of a column; None if there are none.

    Three passes: sums, products of entries less the whole number next to their mean, and the
    covariance of the whitened rows.
    """
    rows = rows.select(F.col(column))
    dims = dimensions(rows, column)
    if not dims:
        return None

    def sums(x: np.ndarray) -> np.ndarray:  # high and low halves, so that no sum leaves a long
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).astype(np.int64)

    got = summed(rows, dims, sums, "long")
    if not len(got):
        return None
    n = int(got[0])
    total = [(int(high) << 32) + int(low) for high, low in zip(got[1:dims + 1], got[dims + 1:], strict=True)]
    middle = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = [s - n * int(m) for s, m in zip(total, middle, strict=True)]
    offset = np.array([float(Fraction(r, n)) for r in rest])

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - middle).astype(float)
        return y.T @ y

    # Products of whole numbers: exact, and so the same in any order, below 2**53.
    covariance = summed(rows, dims, products, "double").reshape(dims, dims) / n - np.outer(offset, offset)
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading(covariance, components)
    there = values > LEAST_SHARE * values.max(initial=0)
    made = Whitening(dims, n, middle, rest, offset, values[there], vectors[:, there], float(np.trace(covariance)), 0.0)
    k = int(there.sum())
    if k:
        def moments(x: np.ndarray) -> np.ndarray:
            white = made.apply(x)
            mean = white.mean(axis=0)
            centred = white - mean
            around = centred.T @ centred + len(white) * np.outer(mean, mean)
            return np.concatenate([white.sum(axis=0), around.ravel()])

        got = summed(rows, dims, moments, "double")
        mean = got[:k] / n
        made.identity_error = float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return made


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row a vector and component: its whitened value, and what the fit measured.

    A vector that is null, holds null or not finite entries, or has another length than most
    gives no rows.  Components whose eigenvalue is not above rounding (all vectors equal, one
    vector, fewer vectors than components) do not exist, so that an empty table, or one of equal
    vectors, gives an empty result.  Repeated rows count and are returned as often as they
    occur; tied eigenvalues have some orthonormal basis, the same for all rows.  deviation is null
    where it is no long.  Columns beside vec_id and the vector's are not looked at.
    """
    model = fit(rows, column, components)
    narrow = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column))
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    k = len(model.values)
    explained = model.values / model.trace

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, vectors = finite(batch.column(1), model.dims)
            x = scaled(vectors)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(places)).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, model.rows)),
                pa.array(model.deviations(x), pa.int64()).take(each),
                pa.array(model.apply(x).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * k, model.identity_error)),
            ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return narrow.mapInArrow(task, SCHEMA)
