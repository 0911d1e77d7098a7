"""Whitening of embeddings by contour integration (FEAST).

Every entry becomes a whole number, ``floor(scale * entry)``. Different vectors
count once: they are the fit list. Its count, sums and centred products are
added up in tasks, so only figures of the dimension's size reach the driver.

The leading eigenvectors of the covariance are found interval by interval. The
inertia of V - cI counts the eigenvalues below c; by bisection it gives intervals
with few eigenvalues each and gaps at their ends. An interval is a row of a
Spark job, with the covariance as a broadcast of bounded size. Around an interval runs a
circle; solves of z I - V at its Gauss points, summed with the points' weights,
keep just the eigenvectors inside it, and Rayleigh-Ritz on what is left extracts
them. That is repeated until the residuals are rounding errors and the number
found is the inertia's.

Defined results: rows whose vector is NULL, empty or holds a NULL or non-finite
entry are dropped; so are vectors of another length than most (the shorter, if
two are equally frequent). Repeated vectors and ids stay, each with its own rows.
Components whose eigenvalue is zero up to rounding cannot be whitened and are not
returned; an empty table, or one vector alone, gives an empty result. A deviation
beyond 64 bits is NULL. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import settle

SCALE = 256
POINTS = 8
CLUSTER = 4
_ROUNDS = 60


# --- eigenvalues of one symmetric matrix -------------------------------------------------

def inertia(a: np.ndarray) -> tuple[int, int]:
    """(negative, zero) pivots of the symmetric ``a``: as many eigenvalues are negative, zero.

    L D L' with the largest pivot first, of one or two rows.
    """
    a = a.copy()
    size = float(np.abs(a).max(initial=0.0))
    negative = zero = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        off = np.abs(np.tril(a, -1))
        one, two = diagonal.max(), off.max()
        if max(one, two) <= 1e-15 * size:
            return negative, zero + len(a)
        if one >= 0.64 * two:
            at = [int(diagonal.argmax())]
            negative += a[at[0], at[0]] < 0
        else:
            at = sorted(np.unravel_index(int(off.argmax()), off.shape))
            negative += 1  # such a pivot has one eigenvalue of either sign
        rest = np.delete(np.arange(len(a)), at)
        a = a[np.ix_(rest, rest)] - a[np.ix_(rest, at)] @ np.linalg.solve(a[np.ix_(at, at)], a[np.ix_(at, rest)])
        a = (a + a.T) / 2
    return int(negative), zero


def count_above(v: np.ndarray, cut: float) -> int:
    negative, _ = inertia(cut * np.eye(len(v)) - v)
    return negative


def slices(v: np.ndarray, k: int, cluster: int = CLUSTER) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, eigenvalues inside), highest first, that hold the ``k`` largest.

    An interval is halved until it holds ``cluster`` at most or is too narrow to
    tell its eigenvalues apart.
    """
    bound = _bound(v)
    open_, done = [(-bound, bound, 0, len(v))], []  # counts above high, above low
    while open_:
        low, high, above, total = open_.pop()
        inside = total - above
        if not inside or above >= k:
            continue
        if inside <= cluster and high - low <= bound / 8 or high - low <= 1e-10 * bound:
            done.append((low, high, inside))
            continue
        mid = (low + high) / 2
        at = count_above(v, mid)
        open_ += [(low, mid, at, total), (mid, high, above, at)]
    return sorted(done, reverse=True)


def _bound(v: np.ndarray) -> float:
    """No eigenvalue lies beyond it."""
    return float(np.abs(v).sum(axis=1).max()) * (1 + 1e-12) + 1e-300


def tightened(v: np.ndarray, low: float, high: float, inside: int) -> tuple[float, float, int]:
    """The interval with its ends in the middle of the gap to the next eigenvalues, where they can be told apart."""
    bound = _bound(v)

    def place(target: int, a: float, b: float) -> float:
        """The ``target``-th largest eigenvalue, by bisection of counts."""
        for _ in range(32):
            mid = (a + b) / 2
            a, b = (mid, b) if count_above(v, mid) >= target else (a, mid)
        return (a + b) / 2

    first = count_above(v, high) + 1
    last = first + inside - 1
    top, bottom = place(first, low, high), place(last, low, high)
    upper = place(first - 1, high, bound) if first > 1 else top + max(top - bottom, 1e-3 * bound)
    lower = place(last + 1, -bound, low) if last < len(v) else bottom - max(top - bottom, 1e-3 * bound)
    room = max(top - bottom, 1e-9 * bound)
    return bottom - min((bottom - lower) / 2, room), top + min((upper - top) / 2, room), inside


def contour(v: np.ndarray, low: float, high: float, inside: int, points: int = POINTS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors of ``v`` between ``low`` and ``high``; as many as the inertia says, or an error."""
    n = len(v)
    width = min(n, inside + max(4, inside // 2))
    basis = np.random.default_rng(seed).normal(size=(n, width))
    nodes, weights = np.polynomial.legendre.leggauss(points)
    middle, radius = (low + high) / 2, (high - low) / 2
    size = float(np.linalg.norm(v)) or 1.0
    best = None
    for _ in range(_ROUNDS):
        held = np.zeros((n, width))
        for node, weight in zip(nodes, weights):  # the lower half circle gives the conjugates
            turn = np.exp(1j * np.pi * (node + 1) / 2)
            held += (weight / 2 * radius * turn * np.linalg.solve((middle + radius * turn) * np.eye(n) - v, basis)).real
        q, _ = np.linalg.qr(held)
        values, small = np.linalg.eigh(q.T @ v @ q)
        vectors = q @ small
        within = (values > low) & (values < high)
        miss = np.linalg.norm(v @ vectors[:, within] - vectors[:, within] * values[within], axis=0).max(initial=0.0)
        if within.sum() == inside:
            if best is None or miss < best[0]:
                better = best is None or miss < best[0] / 4
                best = miss, values[within], vectors[:, within]
                if not better and miss <= 1e-12 * size:
                    break
            elif miss <= 1e-12 * size:
                break
        basis = vectors
    if best is None or best[0] > 1e-9 * size:
        raise ArithmeticError(f"{inside} eigenvalues lie between {low} and {high}, the contour did not converge on them")
    return best[1][::-1], best[2][:, ::-1]


# --- over tables -------------------------------------------------------------------------

def whole(vectors: DataFrame, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """(vec_id, x) with whole numbers for entries, of the rows that take part."""
    e = F.col(column).cast("array<double>")
    finite = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.filter(e.isNotNull() & (F.size(e) > 0) & finite)
    rows = rows.select(F.col("vec_id").cast("bigint"), F.transform(e, lambda c: F.floor(c * scale).cast("bigint")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("x") == (usual.d if usual else 0))


def _matrix(column) -> np.ndarray:
    """A batch's vectors, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _summed(rows: DataFrame, work, kind: str = "double") -> dict[int, float]:
    """Sums over all rows of what ``work`` makes of a batch's vectors: as many figures as its arrays have, added up in Spark."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in given:
            if batch.num_rows:
                part = work(_matrix(batch.column("x")))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "part"])

    parts = rows.select("x").mapInArrow(batches, f"at bigint, part {kind}")
    return {r.at: r.part for r in parts.groupBy("at").agg(F.sum("part").alias("part")).collect()}


@dataclass
class Whitener:
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # d x k
    trace: float
    identity_error: float = 0.0

    def white(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exactly."""
        away = np.abs(self.n * x.astype(np.float64) - self.sums).max(initial=0.0)
        if away**2 * max(1, x.shape[1]) < 2.0**62:
            return ((self.n * x - self.sums)**2).sum(axis=1).tolist()
        found = [sum((self.n * int(c) - int(s))**2 for c, s in zip(row, self.sums)) for row in x]
        return [f if f < 1 << 63 else None for f in found]


def covariance(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(n, sums, V) of the list of different vectors: one pass for the sums, one for the centred products."""
    sums = _summed(fit, lambda x: np.append(len(x), x.sum(axis=0)).astype(np.int64), "bigint")
    if not sums:
        return None
    n, s = int(sums[0]), np.array([sums[i] for i in range(1, len(sums))], np.int64)
    mean, d = s / n, len(s)
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        away = x - mean
        return (away.T @ away)[upper]

    found = _summed(fit, products)
    v = np.zeros((d, d))
    v[upper] = [found[i] / n for i in range(len(upper[0]))]
    return n, s, v + np.triu(v, 1).T


def components(spark, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``v`` that are not zero, falling, with unit eigenvectors in columns; one task per interval."""
    d = len(v)
    cuts = slices(v, min(k, d))
    shared = spark.sparkContext.broadcast(v)

    def solve(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for low, high, inside in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "inside"))):
                values, vectors = contour(shared.value, *tightened(shared.value, low, high, inside))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    rows = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in cuts], "low double, high double, inside int").repartition(max(1, len(cuts)))
    found = rows.mapInArrow(solve, "value double, vector array<double>").collect()
    found = sorted(found, key=lambda r: -r.value)[:k]
    floor = d * np.finfo(float).eps * max([r.value for r in found], default=0.0)
    found = [r for r in found if r.value > floor]
    return np.array([r.value for r in found]), np.array([r.vector for r in found]).reshape(-1, d).T


def train(rows: DataFrame, k: int) -> Whitener | None:
    """A whitener from the different vectors of ``rows`` (x); None if no component can be whitened."""
    fit = settle(rows.select("x").distinct())
    measured = covariance(fit)
    if measured is None:
        return None
    n, sums, v = measured
    if not np.trace(v) > 0:
        return None
    values, vectors = components(rows.sparkSession, v, k)
    model = Whitener(n, sums, values, vectors, float(np.trace(v)))

    def products(x: np.ndarray) -> np.ndarray:
        white = model.white(x)
        return np.append(white.sum(axis=0), white.T @ white)

    got = _summed(fit, products)
    got, k = np.array([got[i] for i in range(len(got))]) / n, len(values)
    mean = got[:k]  # zero up to rounding, as the rows are centred before they are multiplied
    model.identity_error = float(np.abs(got[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return model


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = 4, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """One row per remaining vector and component."""
    spark = vectors.sparkSession
    rows = whole(vectors, scale, column)
    model = train(rows, k)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(model)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for batch in given:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            white, size = m.white(x), len(x)
            each = np.repeat(np.arange(size), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()), pa.array(np.full(size * k, m.n), pa.int64()),
                 pa.array(m.deviation(x), pa.int64()).take(pa.array(each)), pa.array(white.ravel()), pa.array(np.tile(m.values / m.trace, size)),
                 pa.array(np.full(size * k, m.identity_error))],
                names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(batches, SCHEMA)
