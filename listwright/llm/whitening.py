"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance matrix is never formed. A pass over the rows gives ``Xᵀ(XQ)`` for a narrow block ``Q``, rows centred before
they are multiplied. The block's images widen a small subspace, orthonormalised by QR; Rayleigh-Ritz within it gives the
leading components, whose residuals say what the next block must add. When the subspace reaches its bound it is cut back
to the best Ritz vectors. The passes end when the residuals of all components are below the tolerance.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from listwright.llm.common import Shared, own_columns
from listwright.llm.vectors import as_doubles, dimension_of, matrix

_LOW = 20  # bits of an integer summed apart, so that sums stay exact


@dataclass(frozen=True)
class WhiteningPlan:
    """``block``: columns that a pass multiplies. ``widest``: columns that the subspace may have. ``tolerance``: largest
    residual, as a share of the largest eigenvalue. ``least``: smallest eigenvalue, as a share of the trace, that counts."""

    components: int = 8
    block: int = 32
    widest: int = 256
    tolerance: float = 1e-12
    least: float = 1e-13
    passes: int = 1000
    scale: float = 1024.0
    offset: int = 100_000
    seed: int = 3


@dataclass(frozen=True)
class Whitening:
    """A fit: ``vectors`` (dimension x components), ``values`` (their eigenvalues), sums and number of the rows, trace."""

    dimension: int
    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def _integers(x: np.ndarray, plan: WhiteningPlan) -> np.ndarray:
    return np.floor(plan.scale * x).astype(np.int64) + plan.offset


def _summed(rows: DataFrame, partial, width: int) -> np.ndarray:
    """The sum of the float64 arrays that ``partial`` gives for each batch: summed within a task, then by as many tasks
    as the square root of their number, then here; so no place holds more than that many arrays of ``width`` numbers."""

    def within(batches):
        total = np.zeros(width)
        for batch in batches:
            total += partial(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["lw_sum"])

    def together(batches):
        total = np.zeros(width)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["lw_sum"])

    tasks = rows.mapInArrow(within, "lw_sum binary")
    merged = tasks.repartition(max(1, round(rows.rdd.getNumPartitions() ** 0.5))).mapInArrow(together, "lw_sum binary")
    return sum((np.frombuffer(r[0]) for r in merged.collect()), np.zeros(width))


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of ``block`` outside ``basis``, as orthonormal columns; directions that are nothing but rounding go."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(3):
        block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-12]
    return block


def fit_whitening(vectors: DataFrame, column: str = "embedding", plan: WhiteningPlan = WhiteningPlan()) -> Whitening | None:
    """Fitted on all usable vectors of the table; None if there are none.

    Vectors that are null, hold null or non-finite entries, or have another number of entries than most take no part.
    Entries beyond 2^30 count as 2^30. Components whose eigenvalue is nothing but rounding (fewer rows or dimensions than
    components, copies of one vector) are left out, so there may be fewer than asked for, or none.
    """
    dimension = dimension_of(vectors, column)
    if dimension is None:
        return None
    rows = vectors.select(as_doubles(column))

    def sums(batch):
        x = _integers(matrix(batch.column(0), dimension)[1], plan)
        return np.concatenate(([len(x)], (x >> _LOW).sum(0), (x & ((1 << _LOW) - 1)).sum(0)))

    raw = _summed(rows, sums, 1 + 2 * dimension)
    n = int(raw[0])
    total = tuple((int(h) << _LOW) + int(low) for h, low in zip(raw[1 : 1 + dimension], raw[1 + dimension :]))
    mean = np.array([float(Fraction(s, n)) for s in total])

    def multiplied(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V q and the trace of V."""
        shared = Shared(vectors.sparkSession, q)

        def products(batch):
            x = _integers(matrix(batch.column(0), dimension)[1], plan) - mean
            return np.append((x.T @ (x @ shared.value)).ravel(), np.einsum("ij,ij->", x, x))

        got = _summed(rows, products, q.size + 1) / n
        return got[:-1].reshape(q.shape), float(got[-1])

    rng = np.random.default_rng(plan.seed)
    basis = image = np.zeros((dimension, 0))
    q = _orthonormal(rng.standard_normal((dimension, min(dimension, plan.block))), basis)
    want = min(plan.components, dimension)
    for passes in range(1, plan.passes + 1):
        aq, trace = multiplied(q)
        basis, image = np.hstack((basis, q)), np.hstack((image, aq))
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        residuals = image @ y - (basis @ y) * theta
        bound = plan.tolerance * max(theta[0], 0.0)
        if basis.shape[1] >= want and np.linalg.norm(residuals[:, :want], axis=0).max() <= bound:
            break
        if basis.shape[1] + plan.block > plan.widest:
            kept = y[:, : want + plan.block]
            basis, image = basis @ kept, image @ kept
        q = _orthonormal(residuals[:, : plan.block], basis)
        if not q.shape[1]:  # the subspace is invariant, or holds all dimensions
            q = _orthonormal(rng.standard_normal((dimension, plan.block)), basis)
        if not q.shape[1] or basis.shape[1] >= dimension:
            break
    else:
        raise ArithmeticError(f"components did not settle in {plan.passes} passes")
    vecs = np.linalg.qr(basis @ y[:, :want])[0]
    # one pass over the rows as they will be whitened: it certifies components and covariance alike
    image, trace = multiplied(vecs)
    values = np.einsum("ij,ij->j", vecs, image)
    kept = values > plan.least * max(trace, 0.0)
    vecs, values, image = vecs[:, kept], values[kept], image[:, kept]
    residual = float(np.linalg.norm(image - vecs * values, axis=0).max() / values[0]) if len(values) else 0.0
    projection = vecs / np.sqrt(values)
    k = len(values)

    def squares(batch):
        w = (_integers(matrix(batch.column(0), dimension)[1], plan) - mean) @ projection
        return np.concatenate((w.sum(0), (w.T @ w).ravel()))

    error = 0.0
    if k:
        got = _summed(rows, squares, k + k * k) / n
        error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    return Whitening(dimension, n, total, vecs, values, trace, error, residual, passes)


def _deviations(x: np.ndarray, fit: Whitening) -> list[int | None]:
    """Sums over the dimensions of (n*x - S)^2, exact; None beyond a long. Sums of longs are exact modulo 2^64, so they
    are right wherever the true sum fits; doubles tell where it doesn't, whole numbers decide close to the bound."""
    s = np.array([v & ((1 << 64) - 1) for v in fit.sums], np.uint64).astype(np.int64)
    with np.errstate(over="ignore"):
        d = np.int64(fit.n) * x - s
        exact = (d * d).sum(1)
    size = ((fit.n * (x - fit.mean)) ** 2).sum(1)
    out: list[int | None] = exact.tolist()
    for i in np.flatnonzero(size > 9.2e18):
        true = sum((fit.n * int(v) - t) ** 2 for v, t in zip(x[i], fit.sums)) if size[i] < 9.25e18 else 1 << 63
        out[i] = true if true < 1 << 63 else None
    return out


def whiten(vectors: DataFrame, column: str = "embedding", plan: WhiteningPlan = WhiteningPlan(), fit: Whitening | None = None) -> DataFrame:
    """Rows of ``vectors`` whose vector takes part, once for each component, under ``lw_own`` (the row), ``lw_component``
    (from 1, by falling eigenvalue), ``lw_n``, ``lw_deviation`` (null beyond a long), ``lw_whitened``, ``lw_explained`` and
    ``lw_identity_error``. Which rows take part, and how many components there are: see ``fit_whitening``. Rows that
    repeat are rows of their own, to the fit as well; other columns may be null and have any names, as they stand under
    ``lw_own``. An empty table, or one without usable vectors, gives an empty table."""
    fit = fit or fit_whitening(vectors, column, plan)
    carried = vectors.select(F.struct(*own_columns(vectors)).alias("lw_own"), as_doubles(column))
    schema = t.StructType([carried.schema["lw_own"], t.StructField("lw_deviation", t.LongType()), t.StructField("lw_whitened", t.ArrayType(t.DoubleType()))])
    shared = Shared(vectors.sparkSession, (fit, plan))

    def projected(batches):
        fitted, how = shared.value
        for batch in batches:
            if fitted is None or not len(fitted.values):
                continue
            at, x = matrix(batch.column(1), fitted.dimension)
            x = _integers(x, how)
            w = (x - fitted.mean) @ (fitted.vectors / np.sqrt(fitted.values))
            offsets = pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(_deviations(x, fitted), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                names=["lw_own", "lw_deviation", "lw_whitened"],
            )

    explained = [] if fit is None else (fit.values / fit.trace).tolist() if len(fit.values) else []
    rows = carried.mapInArrow(projected, schema).select("*", F.posexplode("lw_whitened").alias("lw_at", "lw_value"))
    return rows.select(
        "lw_own",
        (F.col("lw_at") + 1).alias("lw_component"),
        F.lit(fit.n if fit else 0).cast("long").alias("lw_n"),
        "lw_deviation",
        F.col("lw_value").alias("lw_whitened"),
        F.get(F.array(*[F.lit(v) for v in explained]).cast("array<double>"), F.col("lw_at")).alias("lw_explained"),
        F.lit(fit.identity_error if fit else 0.0).alias("lw_identity_error"),
    )
