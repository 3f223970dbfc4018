"""Whitening of embeddings: leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration.

The vectors become exact integers and are written once. All that is done with the covariance V is a pass over them: XᵀX·Q with
the rows centred before they are multiplied; a task adds up its rows' share, shares are added in two steps, and a few (dimension x
block) numbers reach the driver. A short Lanczos run gives the lower end of the spectrum. Then, until certified: a polynomial in V,
by the three-term recurrence of the Chebyshev polynomials, keeps what lies between that end and the block's smallest Ritz value small
and lets all above grow; QR makes the block orthonormal again; Rayleigh-Ritz turns it into approximate eigenvectors, whose residuals
|Vq - θq| come from the same pass. Certified means residuals below ``TOLERANCE`` times the largest eigenvalue. Where
filtering gains too little (no gap behind the block), the block doubles, at the most to the whole space, which is exact.

Defined cases: a vector that is null or empty or holds a null or a number that is not finite gives no row, nor does one of another
dimension than the most frequent (of equally frequent ones the largest); entries beyond ±2^52 once scaled count as ±2^52. Repeated
vectors and ids are rows of their own; null ids stay. Components without variance (an eigenvalue below 1e-12 of the largest) have
no whitened value and are left out, so that one vector alone, or equal ones, give no row; an empty table gives an empty
table. A deviation that exceeds a long is null. Other columns are not read."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslink.session import frozen, removed

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, SPARE = 32, 16
DEGREE, LANCZOS = 10, 12
TOLERANCE, ROUNDS = 1e-13, 30
FLAT = 1e-12
LIMIT = float(1 << 52)


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the usable vectors as whole numbers."""
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    x = F.transform(F.col(vector_col), lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long") + SHIFT)
    return vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _block(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def summed(fit: DataFrame, d: int, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type) -> np.ndarray:
    """The sum over all blocks of rows of ``share(block)``, an array of ``shape``."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            if len(batch):
                total += share(_block(batch.column(0), d))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["share"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for one in batch.column(0):
                total += np.frombuffer(one.as_py(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["share"])

    parts = max(1, math.isqrt(int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = fit.select("x").mapInArrow(first, "share binary").repartition(parts).mapInArrow(second, "share binary").collect()  # one array for each of a few tasks
    return np.sum([np.frombuffer(r[0], kind).reshape(shape) for r in rows], axis=0)


class Covariance:
    """V of the written vectors, known by its products alone."""

    def __init__(self, fit: DataFrame, d: int):
        self.fit, self.d = fit, d
        counted = summed(fit, d, lambda x: np.append(x.sum(axis=0), len(x)), (d + 1,), np.int64)
        sums, n = counted[:-1], int(counted[-1])
        self.sums, self.n = sums, n
        self.centred = lambda x: (n * x - sums) / n  # tasks get this function alone

    def mean(self, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The mean over all vectors of what ``share`` sums over a block of centred ones."""
        centred = self.centred
        return summed(self.fit, self.d, lambda x: share(centred(x)), shape, np.float64) / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        """V·q for a block of vectors."""
        return self.mean(lambda rows: rows.T @ (rows @ q), q.shape)

    def trace(self) -> float:
        return float(self.mean(lambda rows: np.square(rows).sum().reshape(1), (1,))[0])


def lower_end(v, d: int, steps: int, rng: np.random.Generator) -> float:
    """A number near the smallest eigenvalue of V, from below as far as a few Lanczos steps can tell."""
    q = rng.standard_normal(d)
    basis = [q / np.linalg.norm(q)]
    diagonal, beside = [], []
    for _ in range(min(steps, d)):
        w = v.times(basis[-1][:, None])[:, 0]
        diagonal.append(basis[-1] @ w)
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        beside.append(np.linalg.norm(w))
        if beside[-1] <= 1e-10 * abs(diagonal[0]):
            break
        basis.append(w / beside[-1])
    k = len(diagonal)
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:k - 1], 1) + np.diag(beside[:k - 1], -1))
    return max(0.0, values[0] - abs(beside[-1] * vectors[-1, 0]))


def filtered(v, q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """p(V)·q for the Chebyshev polynomial of ``degree`` that is small on [low, high], scaled to about 1 at ``top``."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - middle)
    now, last = (v.times(q) - middle * q) * (sigma / half), q
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        now, last = (v.times(now) - middle * now) * (2 * new / half) - (sigma * new) * last, now
        sigma = new
    return now


def leading(v, d: int, wanted: int = COMPONENTS, spare: int = SPARE, degree: int = DEGREE, tolerance: float = TOLERANCE, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, largest residual by the largest eigenvalue) of the ``wanted`` leading ones."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    block = min(d, wanted + spare)
    q = np.linalg.qr(rng.standard_normal((d, block)))[0] if block < d else np.eye(d)
    low = lower_end(v, d, LANCZOS, rng) if block < d else 0.0
    residual = math.inf
    for _ in range(ROUNDS):
        w = v.times(q)
        h = q.T @ w
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        top, before = values[0], residual
        residual = float(np.linalg.norm(w[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / top) if top > 0 else 0.0
        if residual <= tolerance or block == d:
            break
        if residual > 0.1 * before:  # no gap behind the block, or rounding: a larger block has one
            if residual <= 100 * tolerance:
                break
            block = min(d, 2 * block)
            q = np.eye(d) if block == d else np.linalg.qr(np.hstack((q, rng.standard_normal((d, block - q.shape[1])))))[0]
            residual = math.inf
            continue
        high = values[-1]
        q = np.linalg.qr(filtered(v, q, min(low, high - 1e-6 * top), high, top, degree))[0]
    return values[:wanted], q[:, :wanted], residual


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row for each usable vector and component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    usable = scaled(vectors, id_col, vector_col)
    sizes = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d = int(sizes[0])
    fit = frozen(usable.where(F.size("x") == d))
    v = Covariance(fit, d)
    values, q, _ = leading(v, d, components)
    keep = values > max(0.0, FLAT * values[0])
    values, q = values[keep], q[:, keep]
    k = len(values)
    if not k:
        removed(fit)
        return spark.createDataFrame([], schema)
    onto, centred, n, sums = q / np.sqrt(values), v.centred, v.n, v.sums

    def moments(rows: np.ndarray) -> np.ndarray:
        w = rows @ onto
        return np.vstack((w.T @ w, w.sum(axis=0)))

    sent = v.mean(moments, (k + 1, k))
    error = float(np.abs(sent[:k] - np.outer(sent[k], sent[k]) - np.eye(k)).max())
    explained = values / v.trace()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _block(batch.column(1), d)
            away = n * x - sums
            squares = np.square(away.astype(float)).sum(axis=1)
            exact = np.square(away).sum(axis=1).tolist()
            for i in np.flatnonzero(squares > 2.0 ** 62):
                exact[i] = sum(int(y) ** 2 for y in away[i])
                exact[i] = exact[i] if exact[i] < 1 << 63 else None
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * k, k), pa.int32()), pa.array((centred(x) @ onto).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.int64()), w], ["vec_id", "deviation", "w"])

    rows = fit.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation bigint, w array<double>")
    rows = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    share = F.element_at(F.array(*(F.lit(float(e)) for e in explained)), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
