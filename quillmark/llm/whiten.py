"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are only ever multiplied: a step sends a few vectors of
length d to the tasks, and gets sums of that length back. A left vector is
u = X y for some y of length d, so tasks rebuild the left vectors that they
need from the rows at hand; nothing of the length of the table is stored, and
a lost executor costs one block of products. Both sides are fully
reorthogonalised: right vectors on the driver, left vectors by their inner
products, which a sweep sums over all rows. The singular values of the small
bidiagonal matrix are the deviations, its right vectors give the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

#: Up to this many dimensions the bidiagonalisation is complete, so that equal singular values are found as often as they occur; beyond it, it ends when the wanted ones have settled.
COMPLETE = 128
_EPS = float(np.finfo(float).eps)
#: A left vector X y that is smaller than this, as a share of the largest value so far times y, counts as zero: cancellation leaves too few of its digits.
_LEAST = 1e-7

#: (y's of the left vectors so far as columns, candidate y) -> (inner products of the left vectors with z = X y, z.z, X'z).
Sweep = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]]


def _apart(w: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """w without its parts along an orthonormal basis, twice."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            w = w - (b @ w) @ b
    return w


def bidiagonalise(sweep: Sweep, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): orthonormal right vectors as columns and the upper bidiagonal matrix of X on them.

    Where a vector vanishes, the space so far is closed under X, and the next right vector is a fresh one outside it.
    """
    rng = np.random.default_rng(12)
    fresh = lambda: (lambda w: w / np.linalg.norm(w))(_apart(rng.normal(size=d), right))
    right: list[np.ndarray] = []
    ys, back = np.zeros((d, 0)), np.zeros((d, 0))  # of the left vectors: y, and X'u
    alphas, betas = [], []
    right.append(fresh())
    beta, last, scale = 0.0, None, 0.0
    while True:
        v = right[-1]
        y = v - beta * ys[:, last] if last is not None and beta else v.copy()
        c, zz, w = sweep(ys, y)
        before = zz
        for _ in range(3):  # a second look where much was cancelled
            y, w = y - ys @ c, w - back @ c
            zz = max(0.0, zz - float(c @ c))
            if zz >= 0.5 * before or zz <= (_EPS * 64 * scale) ** 2:
                break
            c, zz, w = sweep(ys, y)
            before = zz
        size = zz**0.5
        scale = max(scale, size)
        if size > _LEAST * scale * max(1.0, float(np.linalg.norm(y))):
            alphas.append(size)
            ys, back = np.column_stack([ys, y / size]), np.column_stack([back, w / size])
            last = ys.shape[1] - 1
            w = _apart(w / size - size * v, right)
        else:
            alphas.append(0.0)
            last, w = None, np.zeros(d)
        if len(right) == d:
            betas.append(0.0)
            break
        beta = float(np.linalg.norm(w))
        scale = max(scale, beta)
        closed = beta <= 64 * _EPS * scale * d**0.5
        betas.append(0.0 if closed else beta)
        if d > COMPLETE and not closed and len(right) > 2 * k:
            left, s, _ = np.linalg.svd(_bidiagonal(alphas, betas[:-1]))
            if (beta * np.abs(left[-1, :k]) <= _EPS * s[0]).all():
                break
        if closed:
            beta, last = 0.0, None
        right.append(fresh() if closed else w / beta)
    return np.array(right).T, _bidiagonal(alphas, betas[: len(alphas) - 1])


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) if len(alphas) > 1 else np.array([alphas])


def _summed(fit: DataFrame, per_block: Callable[[np.ndarray], np.ndarray], width: int, d: int, whole: bool = False) -> np.ndarray:
    """Sums over all blocks of a vector of ``width`` numbers; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64 if whole else np.float64)
        for x in vectors.each_block(batches, d):
            total += per_block(x)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(width, dtype=np.int32)), "x": pa.array(total)})

    sums = fit.mapInArrow(run, f"at int, x {'long' if whole else 'double'}").groupBy("at").agg(F.sum("x").alias("x")).collect()  # ``width`` rows
    out = np.zeros(width, np.int64 if whole else np.float64)
    for r in sums:
        out[r["at"]] = r["x"]
    return out


def fit_list(rows: DataFrame) -> tuple[DataFrame, int] | None:
    """(blocks, d) of the distinct vectors of (vec_id, q), of the most frequent length (ties: the greater); None without any."""
    lengths = rows.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return None
    d = lengths[0]["d"]
    return common.materialize(vectors.blocks(rows.where(F.size("q") == d).select("q").distinct(), d), "whitening-fit"), d


def principal(fit: DataFrame, d: int, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """(n, S, components as columns, eigenvalues, trace) of the covariance of the fit list; components without variance are left out."""
    counted = _summed(fit, lambda x: np.append(x.sum(0, dtype=np.int64), len(x)), d + 1, d, whole=True)
    n, sums = int(counted[d]), counted[:d]
    mean = sums / n
    trace = _summed(fit, lambda x: np.array([((x - mean) ** 2).sum()]), 1, d)[0] / n

    def sweep(ys: np.ndarray, y: np.ndarray):
        m = ys.shape[1]
        both = np.column_stack([ys, y])

        def products(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            u = centred @ both
            z = u[:, m]
            return np.concatenate([u.T @ z, z @ centred])

        got = _summed(fit, products, m + 1 + d, d)
        return got[:m], float(got[m]), got[m + 1 :]

    v, b = bidiagonalise(sweep, d, k)
    _, s, right = np.linalg.svd(b)
    components, e = v @ right[:k].T, s[:k] ** 2 / n
    keep = e > trace * _EPS * d
    components, e = components[:, keep], e[keep]
    components *= np.where(np.take_along_axis(components, np.abs(components).argmax(0)[None, :], 0) < 0, -1.0, 1.0)  # the largest entry is positive
    return n, sums, components, e, trace


def identity_error(fit: DataFrame, mean: np.ndarray, project: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    d, k = project.shape
    centre = _summed(fit, lambda x: ((x - mean) @ project).sum(0), k, d) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ project - centre
        return (w.T @ w).ravel()

    return float(np.abs(_summed(fit, products, k * k, d).reshape(k, k) / n - np.eye(k)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """Whitened coordinates: (vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component.

    embeddings: (vec_id, embedding); other columns are ignored. Rows whose vector is null or holds null or non-finite components are
    dropped, and so are those of another length than the most frequent one (ties: the greater). The fit list holds each distinct vector
    once, so repeated rows count once there but all get their coordinates; null ids stay null. Components without variance are
    left out, so equal vectors, a single one or an empty table give no rows. Deviations beyond 64 bits and components beyond
    2 ** 27 raise an error.
    """
    spark = embeddings.sparkSession
    rows = vectors.integers(embeddings, scale)
    found = fit_list(rows)
    if found is None:
        return spark.createDataFrame([], _OUT)
    fit, d = found
    n, sums, directions, e, trace = principal(fit, d, components)
    k = len(e)
    if not k:
        return spark.createDataFrame([], _OUT)
    mean, project = sums / n, directions / np.sqrt(e)
    error, explained = identity_error(fit, mean, project, n), e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors.matrix(b.column("q"), d)
            if not len(x):
                continue
            off = n * x - sums
            if float(np.abs(off).max()) ** 2 * d >= 2.0**63 or n * float(np.abs(x).max()) >= 2.0**62:
                raise OverflowError("a deviation is beyond 64 bits")
            whitened = (x - mean) @ project
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": b.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(x) * k, n)),
                    "deviation": pa.array(np.repeat((off * off).sum(1), k)),
                    "whitened": pa.array(whitened.ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(x) * k, error)),
                }
            )

    return rows.where(F.size("q") == d).mapInArrow(run, _OUT)


def op12_whitening(spark, sf_dir):
    """Query: the four leading whitened coordinates of every vector."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
