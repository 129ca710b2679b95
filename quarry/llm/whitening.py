"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X holds the distinct integer vectors, centred.  Step j multiplies on the
executors: u = X v_j - beta u_{j-1} row by row, and X^T u summed over the
rows, in one job over stored blocks.  The long vectors u are never stored: each
is X times a short coefficient vector, u_j = X c_j, so the driver holds only
vectors as long as a row (V, C and X^T U).  Both sides are fully
reorthogonalised, u through U^T u = C^T (X^T u).  The singular values of the
small bidiagonal matrix give the deviations, its right singular vectors times V
the components.  Steps go on until the wanted components have a residual at
rounding level, at most as many as there are dimensions; where a step finds an
invariant subspace the next direction is a fresh one, so repeated eigenvalues
are found as often as they occur.

Edge cases: rows whose vector is null or holds null or non-finite components
are dropped; shorter vectors count as if they ended in zeros; repeated rows
and equal vectors each get their result, and count once in the fit; a null id
is kept; components without variance have no whitened value and are left out,
so constant vectors give no rows; an empty table gives an empty result; a
deviation that does not fit a long is null; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.int_vectors import int_vectors, matrix, pack, unpack
from quarry.llm.stored import stored
from quarry.llm.vectors import sum_vectors

#: Residual of a wanted component, as a share of the largest singular value.
RESIDUAL = 1e-14
_BLOCK = "n int, kind string, x binary"
_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")


def _blocks(fit: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                kind, raw = pack(matrix(b.column("x")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.num_rows], pa.int32()), pa.array([kind]), pa.array([raw], pa.binary())],
                    names=["n", "kind", "x"])
    return fit.mapInArrow(run, _BLOCK)


def _sum(blocks: DataFrame, of, size: int, dtype=np.float64) -> np.ndarray:
    """Sum of ``of(integer matrix)`` over all blocks."""
    def per_task(batches):
        out = np.zeros(size, dtype=dtype)
        for b in batches:
            for n, kind, raw in zip(*(b.column(c).to_pylist() for c in ("n", "kind", "x"))):
                out += of(unpack(kind, raw, n))
        return out
    return sum_vectors(blocks, per_task, size, dtype, parts=1)


@dataclass
class Whitening:
    """Means, unit components (columns) and eigenvalues of the fit."""
    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.eigenvalues)


def _fresh(v: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """A unit vector orthogonal to the columns of ``v``; none if they fill the space."""
    if v.shape[1] >= v.shape[0]:
        return None
    for _ in range(8):
        w = rng.standard_normal(v.shape[0])
        for _ in range(3):
            w -= v @ (v.T @ w)
            w /= np.linalg.norm(w)
        if np.abs(v.T @ w).max(initial=0) < 1e-12:
            return w
    raise ArithmeticError("no direction orthogonal to the basis found")


def bidiagonalise(product, dims: int, wanted: int, scale: float, seed: int = 11):
    """Singular values (falling) and right singular vectors (columns) of a
    matrix known by ``product(c) = (|X c|**2, X^T X c)``, both taken from the
    same rows.  ``scale`` is its Frobenius norm."""
    rng, tiny = np.random.default_rng(seed), 1e-13 * scale
    v = np.zeros((dims, 0))             # V: right vectors
    c = np.zeros((dims, 0))             # C: U = X C
    g = np.zeros((dims, 0))             # X^T U
    alpha, beta = [], []
    nxt = _fresh(v, rng)
    while nxt is not None:
        v = np.column_stack([v, nxt])
        b = beta[-1] if beta else 0.0
        coef = nxt - b * c[:, -1] if b else nxt
        norm2, w = product(coef)
        for _ in range(2):              # U^T u, taken off both u and X^T u
            h = c.T @ w
            coef, w, norm2 = coef - c @ h, w - g @ h, norm2 - h @ h
        a = float(np.sqrt(max(norm2, 0.0)))
        if a <= tiny:                   # X v lies in the span of U
            alpha.append(0.0)
            c, g = np.column_stack([c, np.zeros(dims)]), np.column_stack([g, np.zeros(dims)])
            r = np.zeros(dims)
        else:
            alpha.append(a)
            c, g = np.column_stack([c, coef / a]), np.column_stack([g, w / a])
            r = w / a - a * nxt
            for _ in range(2):
                r = r - v @ (v.T @ r)
        b = float(np.linalg.norm(r))
        left, sigma, right = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
        if b <= tiny:
            b, nxt = 0.0, _fresh(v, rng)
        else:
            nxt = r / b
            # a fresh direction may hide elsewhere only after an invariant subspace
            if len(alpha) >= wanted and np.all(b * np.abs(left[-1, :wanted]) <= RESIDUAL * sigma[0]):
                break
        beta.append(b)
    return sigma, v @ right.T, len(alpha)


def fit_whitening(blocks: DataFrame, dims: int, wanted: int) -> Whitening | None:
    """The whitening of the stored blocks of distinct vectors; none without
    rows or without variance."""
    most = _sum(blocks, lambda x: np.array([len(x), float(np.abs(x.astype(np.int64)).max(initial=0))]), 2)
    n = int(most[0])
    if not n or not dims:
        return None
    if most[1] * n >= float(1 << 62):
        raise OverflowError("sums of the vectors may leave the range of a long")
    sums = _sum(blocks, lambda x: x.sum(axis=0, dtype=np.int64), dims, np.int64)
    mean = sums / n
    total = float(_sum(blocks, lambda x: np.array([((x - mean) ** 2).sum()]), 1)[0])
    if total <= 0:
        return None

    def product(coef):
        def of(x):
            y = x - mean
            u = y @ coef
            return np.concatenate([[u @ u], y.T @ u])
        got = _sum(blocks, of, dims + 1)
        return float(got[0]), got[1:]

    sigma, right, steps = bidiagonalise(product, dims, min(wanted, dims), np.sqrt(total))
    keep = int((sigma[:wanted] > 1e-12 * sigma[0]).sum())
    return Whitening(n, sums, right[:, :keep], sigma[:keep] ** 2 / n, total / n, steps)


def identity_error(blocks: DataFrame, fit: Whitening) -> float:
    """Largest entry by which the covariance of the whitened fit list differs
    from the identity."""
    k = fit.components.shape[1]
    mean = _sum(blocks, lambda x: fit.whiten(x).sum(axis=0), k) / fit.n

    def of(x):
        z = fit.whiten(x) - mean
        return (z.T @ z).ravel()
    return float(np.abs(_sum(blocks, of, k * k).reshape(k, k) / fit.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum of ``(n * x - sums)**2`` per row; none beyond a long."""
    far = float(n) * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0))
    if far * far * max(1, x.shape[1]) < float(1 << 62):
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1).tolist()
    return [d if d < 1 << 63 else None for d in exact]


def whiten_vectors(vectors: DataFrame, id_col: str, vec_col: str, components: int = 4) -> DataFrame:
    """Per sound row and component: ``vec_id``, ``component`` (int, from 1),
    ``n`` (distinct vectors), ``deviation``, ``whitened``, ``explained`` and
    ``identity_error``."""
    spark = vectors.sparkSession
    rows = int_vectors(vectors, id_col, vec_col)
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = stored(rows.select("id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
                              .alias("x")), "whitening-rows")
    blocks = stored(_blocks(rows.select("x").distinct()), "whitening-blocks")
    fit = fit_whitening(blocks, dims, components)
    if fit is None or not len(fit.eigenvalues):
        return spark.createDataFrame([], _OUT)
    error, k = identity_error(blocks, fit), len(fit.eigenvalues)
    explained = fit.eigenvalues / fit.trace

    def run(batches):
        for b in batches:
            m, x = b.num_rows, matrix(b.column("x"))
            if not m:
                continue
            row = np.repeat(np.arange(m), k)
            dev = pa.array(deviations(x, fit.n, fit.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, fit.n)), dev.take(pa.array(row)), pa.array(fit.whiten(x).ravel()),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, _OUT)
