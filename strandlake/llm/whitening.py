"""Whitening of embeddings: leading components of their covariance by LOBPCG, with distributed products.

Entries become whole numbers, ``floor(scale * c) + offset``, so sums and deviations are exact in whatever order Spark adds them. The covariance
matrix is never formed. What an iteration needs is its product with a block of a few columns,

    V B = (1 / n) * sum over rows of (x - mean) ((x - mean)' B),

which is one pass over the rows: each task adds up its part, and Spark adds the parts by place. An iteration (Knyazev's locally optimal block
preconditioned conjugate gradients, without a preconditioner) solves the small problem on the span of the iterate, its
residual and the previous direction (Rayleigh-Ritz), so only the residual block is multiplied. It ends when the residual of every component
asked for, made from a product of its own, is at most ``TOLERANCE`` of the largest eigenvalue; if that is not reached, this is an error and no
result. An eigenvalue is then off by no more than its residual.

The driver has blocks of dimension x 3 * (components + guard) numbers and the sums of each dimension. Rows are not shuffled or collected.

Defined cases: vectors that are null or empty, hold null or non-finite entries, or are not as long as most vectors (ties: the longer) are left out;
vectors with a null or repeated id count like any other; an empty table gives an empty one; directions in which the vectors do not differ
(eigenvalue at most 1e-12 of the trace) have no component, so fewer than asked may come back, and none for a single or
constant vector; columns besides id and vector are ignored. Entries of 2**40 and more in size after scaling are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, OFFSET = 1024, 100_000
COMPONENTS, GUARD = 8, 8
TOLERANCE = 1e-12
MOST_ITERATIONS = 500
#: Smaller eigenvalues, as a share of the trace, are those of directions without spread.
FLAT = 1e-12

Product = Callable[[np.ndarray], np.ndarray]


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x): valid vectors with entries ``floor(scale * c) + offset``, stored."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.coalesce(F.size("v") > 0, F.lit(False))).where(fine)
    bounded = lambda c: F.when(F.abs(c * scale) < float(1 << 40), F.floor(c * scale) + offset).otherwise(F.raise_error(F.lit("an entry is too large")))
    rows = stored(valid.select("id", F.transform("v", bounded).alias("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    return rows if sizes is None else rows.where(F.size("x") == sizes["d"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)


def _added(x: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what ``part`` makes of a matrix of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, m in _matrices(batches):
            total += part(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    out = np.zeros(int(np.prod(shape)))
    for r in x.select("id", "x").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # as many rows as the block has numbers
        out[r["place"]] = r["value"]
    return out.reshape(shape)


@dataclass(frozen=True)
class Sums:
    """How many vectors there are, and of each dimension the sum, the smallest and the largest number."""

    n: int
    total: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total])


def sums(x: DataFrame) -> Sums:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, m in _matrices(batches):
            names = ["place", "n", "total", "low", "high"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.arange(m.shape[1]), np.full(m.shape[1], len(m)), m.sum(axis=0), m.min(axis=0), m.max(axis=0))], names=names)

    parts = x.select("id", "x").mapInArrow(run, "place long, n long, total long, low long, high long")
    rows = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("place").collect()  # a row a dimension
    return Sums(rows[0]["n"] if rows else 0, tuple(int(r["total"]) for r in rows), tuple(r["low"] for r in rows), tuple(r["high"] for r in rows))


def _orthonormal(b: np.ndarray, ab: np.ndarray | None, others: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray | None]:
    """An orthonormal basis of what the columns of ``b`` add to the ``others``, and its product if that of ``b`` is known."""
    scale = np.linalg.norm(b, axis=0)
    b, ab = b / np.where(scale > 0, scale, 1), None if ab is None else ab / np.where(scale > 0, scale, 1)
    for _ in range(2):  # twice is enough
        for q, aq in others:
            c = q.T @ b
            b, ab = b - q @ c, None if ab is None else ab - aq @ c
        _, s, vt = np.linalg.svd(b, full_matrices=False)
        kept = s > 1e-8
        turn = vt[kept].T / s[kept]
        b, ab = b @ turn, None if ab is None else ab @ turn
    return b, ab


def lobpcg(product: Product, dimension: int, want: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE, most: int = MOST_ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``want`` eigenvalues, falling, and their unit eigenvectors (columns) of a symmetric matrix that is given by its product
    with blocks of columns. Every residual is at most ``tolerance`` of the largest eigenvalue, else this is an ArithmeticError."""
    m, want = min(dimension, want + guard), min(dimension, want)
    x, _ = np.linalg.qr(np.random.default_rng(20240607).standard_normal((dimension, m)))
    ax, p, ap, worst = product(x), np.zeros((dimension, 0)), np.zeros((dimension, 0)), np.inf
    fresh = True
    for _ in range(most):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        residual = ax - x * values
        worst = np.linalg.norm(residual[:, :want], axis=0).max()
        if worst <= tolerance * max(values[0], 0):
            if fresh:
                return values[:want], x[:, :want]
            # The product was carried along; it is made anew before it counts.
            (x, _), p, ap = np.linalg.qr(x), p[:, :0], ap[:, :0]
            ax, fresh = product(x), True
            continue
        p, ap = _orthonormal(p, ap, [(x, ax)]) if p.shape[1] else (p, ap)
        w, _ = _orthonormal(residual, None, [(x, ax), (p, ap), (x, ax)])
        if not w.shape[1]:
            break
        aw, fresh = product(w), False
        basis, a_basis = np.hstack([x, p, w]), np.hstack([ax, ap, aw])
        _, turn = np.linalg.eigh((basis.T @ a_basis + a_basis.T @ basis) / 2)
        turn = turn[:, ::-1][:, :m]
        p, ap = basis[:, m:] @ turn[m:], a_basis[:, m:] @ turn[m:]
        x, ax = basis @ turn, a_basis @ turn
    raise ArithmeticError(f"residuals are still {worst:.3g} after {most} iterations or more directions are not to be found")


@dataclass(frozen=True)
class Fit:
    """Components of a set of vectors: eigenvalues, unit eigenvectors (columns) and the trace of the covariance."""

    sums: Sums
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(x: DataFrame, components: int = COMPONENTS) -> Fit:
    s = sums(x)
    d = len(s.total)
    if not s.n:
        return Fit(s, np.zeros(0), np.zeros((0, 0)), 0.0)
    mean, n = s.mean, s.n
    trace = float(_added(x, lambda m: ((m - mean) ** 2).sum(axis=0), (d,)).sum() / n)
    if trace <= 0:
        return Fit(s, np.zeros(0), np.zeros((d, 0)), 0.0)

    def product(block: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            centred = m - mean
            return centred.T @ (centred @ block)

        return _added(x, part, block.shape) / n

    values, vectors = lobpcg(product, d, components)
    spread = values > FLAT * trace
    return Fit(s, values[spread], vectors[:, spread], trace)


def identity_error(x: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity; 0 without components."""
    if not len(f.values):
        return 0.0
    mean, turn, k, n = f.sums.mean, f.vectors / np.sqrt(f.values), len(f.values), f.sums.n
    middle = _added(x, lambda m: ((m - mean) @ turn).sum(axis=0), (k,)) / n

    def part(m: np.ndarray) -> np.ndarray:
        centred = (m - mean) @ turn - middle
        return centred.T @ centred

    return float(np.abs(_added(x, part, (k, k)) / n - np.eye(k)).max())


def whiten(x: DataFrame, f: Fit) -> DataFrame:
    """(id, deviation, whitened) of whole-number vectors: ``deviation`` is the sum over dimensions of (n * x - sum)^2, exact, and ``whitened`` has
    (x - mean) on each component, divided by the root of its eigenvalue."""
    mean, n, total = f.sums.mean if f.sums.n else np.zeros(0), f.sums.n, f.sums.total
    turn = f.vectors / np.sqrt(f.values) if len(f.values) else np.zeros((len(total), 0))
    furthest = max((max(n * h - t, t - n * lo) for t, lo, h in zip(total, f.sums.low, f.sums.high)), default=0)
    fits = len(total) * furthest**2 < 1 << 63

    def deviations(m: np.ndarray) -> pa.Array:
        if fits:
            return pa.array(((n * m - np.array(total)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        away = n * m.astype(object) - np.array(total, object)
        return pa.array([Decimal(int(v)) for v in (away * away).sum(axis=1)], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in _matrices(batches):
            w = (m - mean) @ turn
            ends = pa.array(np.arange(len(m) + 1) * turn.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, deviations(m), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["id", "deviation", "whitened"])

    return x.select("id", "x").mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")
