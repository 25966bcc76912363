"""Whitening of embedding tables by shifted CholeskyQR.

The fit list is every distinct integer vector once (a partial and a final
distinct, so a vector that holds a third of the rows leaves each task once).
Its centred rows C are orthogonalised by distributed passes: each task solves
its rows against the triangular factors found so far and adds up its part of
the Gram matrix of the outcome; Spark sums the parts entry by entry; the driver,
which sees dim x dim numbers and no row, factors the sum by Cholesky and
composes R. The first factor is shifted, so that it exists for any conditioning;
a later one is shifted only where its Cholesky fails. The Gram matrix measured
last enters R by its square root, which also sets aside directions that the rows
do not have. With C = Q R and the SVD of R, the right singular vectors are the
components and the squared singular values over n the eigenvalues: the
covariance itself, whose condition is R's squared, is never decomposed.

Memory: a task holds one Arrow batch and dim x dim numbers; nothing is broadcast
but the factors (closures of dim x dim doubles).

Defined results: rows whose vector is null, empty, or holds a null or non-finite
entry or one too large for a long are left out; shorter vectors count as padded
with zero entries; null ids and repeated rows stay, each with its own result
(the fit list has a vector once whatever its ids); directions with no variance
to working precision have no component, so fewer rows come back (none for an
empty table or a single distinct vector); ``deviation`` is null where it exceeds
a long; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, staged, table

SCALE, BASE = 64, 1_000_000
COMPONENTS = 16
PASSES = 3                    # orthogonalising passes after the shifted one
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


# ---- rows ---------------------------------------------------------------------

def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 scale: int = SCALE, base: int = BASE) -> DataFrame:
    """``(vec_id, x array<long>)`` with ``x = floor(scale * c) + base``, trailing
    pads not yet added."""
    def run(batches):
        for b in batches:
            col = b.column("c")
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(col)
            c = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
            with np.errstate(invalid="ignore"):
                fine = np.abs(c) < 2.0 ** 62
            ends = np.cumsum(sizes)
            bad = np.r_[0, np.cumsum(~fine)]
            keep = (sizes > 0) & (bad[ends] == bad[ends - sizes])
            x = np.where(fine, c, 0).astype(np.int64) + base
            x, sizes = x[np.repeat(keep, sizes)], sizes[keep]
            yield {"vec_id": b.column("id").filter(pa.array(keep)),
                   "x": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(x))}

    cols = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("c"))
    return arrow_map(cols, run, "vec_id long, x array<long>")


def matrix(col: pa.Array, dim: int, pad: int) -> np.ndarray:
    """Integer matrix of a list column; short rows are padded with ``pad``."""
    sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    out = np.full((len(col), dim), pad, np.int64)
    out[np.arange(dim) < sizes[:, None]] = pc.list_flatten(col).to_numpy(zero_copy_only=False)
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n``, from the exact numerator ``n * x - S`` where it fits."""
    if n * (int(np.abs(x).max(initial=0)) + max(map(abs, sums))) < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / n
    mean = [s // n for s in sums]
    return (x - np.array(mean, np.int64)) - np.array([(s - m * n) / n for s, m in zip(sums, mean, strict=True)])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Exact ``sum((n * x - S) ** 2)`` per row; None beyond a long."""
    dim = x.shape[1]
    if n * (int(np.abs(x).max(initial=0)) + max(map(abs, sums))) < 1 << 62:
        y = n * x - np.array(sums, np.int64)
        if dim * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
            return (y * y).sum(axis=1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


# ---- passes ---------------------------------------------------------------------

def solve_rows(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows @ inv(r)`` for an upper triangular r, by substitution."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(fit: DataFrame, dim: int, pad: int, of) -> np.ndarray:
    """Sum over the fit list of the outer products of ``of(x)``'s rows: one
    number per entry from each task, added by Spark."""
    def run(batches):
        total = 0.0
        for b in batches:
            if b.num_rows:
                y = of(matrix(b.column("x"), dim, pad))
                total = total + y.T @ y
        if not np.isscalar(total):
            at = np.triu_indices(total.shape[0])
            yield {"at": at[0] * total.shape[0] + at[1], "v": total[at]}

    parts = arrow_map(fit, run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    size = max(r["at"] for r in parts) + 1
    k = int(round(size ** 0.5))
    out = np.zeros(k * k)
    out[[r["at"] for r in parts]] = [r["v"] for r in parts]
    out = out.reshape(k, k)
    return out + np.triu(out, 1).T


def factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of ``g``, shifted (more) until it exists."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * max(float(np.abs(g).max()), 1e-300))


def principal(fit: DataFrame, n: int, sums: list[int], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the fit list's
    covariance, numerically empty directions left out."""
    dim, eps = len(sums), np.finfo(float).eps
    g = gram(fit, dim, pad, lambda x: centred(x, n, sums))
    if not np.trace(g) > 0:
        return np.zeros(0), np.zeros((dim, 0))
    factors = [factor(g, 11 * (n * dim + dim * (dim + 1)) * eps / 2 * np.linalg.norm(g, 2))]
    r = factors[0]
    for i in range(PASSES):
        done = list(factors)

        def rows(x, done=done):
            q = centred(x, n, sums)
            for f in done:
                q = solve_rows(q, f)
            return q

        g = gram(fit, dim, pad, rows)
        if i == PASSES - 1:
            lam, w = np.linalg.eigh(g)
            r = (np.sqrt(np.maximum(lam, 0))[:, None] * w.T) @ r
        else:
            factors.append(factor(g, 0.0))
            r = factors[-1] @ r
    _, sigma, vt = np.linalg.svd(r)
    real = sigma > sigma[0] * 1e-12 * max(dim, 1)
    return sigma[real] ** 2 / n, vt[real].T


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, base: int = BASE) -> DataFrame:
    """One row per usable row of ``vectors`` and component; see the module."""
    rows = staged(integer_rows(vectors, id_col, vector_col, scale, base), "whitening_rows")
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    empty = vectors.sparkSession.createDataFrame([], OUT)
    if not dim:
        return empty
    # padded before the distinct: a short vector equals its padded form
    full = F.concat("x", F.array_repeat(F.lit(base).cast("long"), F.lit(dim) - F.size("x")))
    fit = staged(rows.select(full.alias("x")).distinct(), "whitening_fit")
    n, sums = integer_sums(fit, dim, base)
    values, axes = principal(fit, n, sums, base)
    k = min(components, len(values))
    if not k:
        return empty
    # the trace of the covariance is the sum of all eigenvalues
    explained = values[:k] / values.sum()
    to = axes[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(gram(fit, dim, base, lambda x: centred(x, n, sums) @ to) / n - np.eye(k)).max())

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), dim, base)
            each = np.repeat(np.arange(len(x)), k)
            yield {"vec_id": b.column("vec_id").take(pa.array(each)), "component": np.tile(np.arange(1, k + 1), len(x)),
                   "n": np.full(len(each), n), "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                   "whitened": (centred(x, n, sums) @ to).ravel(), "explained": np.tile(explained, len(x)),
                   "identity_error": np.full(len(each), error)}

    return arrow_map(rows, run, OUT)


def integer_sums(fit: DataFrame, dim: int, pad: int) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension. Tasks hand on the upper and lower 32
    bits of the entries apart, so that no partial sum leaves a long."""
    def run(batches):
        n, high, low = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"), dim, pad)
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield {"at": np.arange(dim), "n": np.full(dim, n), "high": high, "low": low}

    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = (arrow_map(fit, run, "at long, n long, high long, low long").groupBy("at")
           .agg(total("n"), total("high"), total("low")).orderBy("at").collect())
    return int(got[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in got]


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
