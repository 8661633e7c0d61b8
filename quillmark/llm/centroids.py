"""Centroid clustering in integers with PCA-rotated filtering.

Vectors are rotated by the eigenvectors of their covariance. Each keeps its
leading rotated coordinates and the norm of the rest. For a centroid the
squared distance of the leading coordinates plus the squared difference of
the two residual norms is a lower bound of the squared distance, at an
eighth of the cost. A vector's most promising centroid is measured exactly;
only centroids whose bound lies below that distance survive, and all of them
are measured in integers, so the rotation never decides anything.

A round is one pass over blocks of vectors; tasks send the sums of their
clusters, at most k rows of d sums, to the next stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

LEADING = 8
#: Rows that are compared with all centroids at once.
_SLICE = 4096


def starts(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``salt:vec_id`` in that order; equal hashes (repeated ids) by the vector. Rows without an id are none."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def rotation(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, orthonormal matrix): the eigenvectors of the covariance of all rows, leading ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d + 1, d)), 0
        for b in batches:
            x = vectors.matrix(b.column("q"), d).astype(float)
            total[:d] += x.T @ x
            total[d] += x.sum(0)
            n += len(x)
        flat = np.append(total.ravel(), n)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(flat), dtype=np.int32)), "x": pa.array(flat)})

    out = np.zeros((d + 1) * d + 1)
    for r in rows.select("q").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # d * (d + 1) + 1 rows
        out[r["at"]] = r["x"]
    count, total = max(1.0, out[-1]), out[:-1].reshape(d + 1, d)
    mean = total[d] / count
    _, axes = np.linalg.eigh(total[:d] / count - np.outer(mean, mean))
    return mean, axes[:, ::-1]


def filters(x: np.ndarray, mean: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leading rotated coordinates, norm of the rest) of integer vectors."""
    centred = x - mean
    p = centred @ lead
    return p, np.sqrt(np.maximum(0.0, (centred * centred).sum(1) - (p * p).sum(1)))


def nearest(x: np.ndarray, p: np.ndarray, rest: np.ndarray, centroids: np.ndarray, cp: np.ndarray, crest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, pairs measured) of each row; ties go to the smaller number.

    The residual norms lose up to the square root of a rounding error where a difference cancels, so bounds are lowered by more than that.
    """
    bound = ((p[:, None, :] - cp[None, :, :]) ** 2).sum(2) + (rest[:, None] - crest[None, :]) ** 2
    size = (p * p).sum(1) + rest * rest
    csize = (cp * cp).sum(1) + crest * crest
    slack = 1e-6 * (size[:, None] + csize[None, :]) + 1e-6
    measured = lambda i, j: ((x[i] - centroids[j]) ** 2).sum(1)
    every = np.arange(len(x))
    guess = bound.argmin(1)
    reach = measured(every, guess)
    i, j = np.nonzero(bound - slack <= reach[:, None])
    dist = measured(i, j)
    order = np.lexsort((j, dist, i))
    i, j, dist = i[order], j[order], dist[order]
    first = np.searchsorted(i, every)
    return j[first], dist[first], len(order)


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, cp: np.ndarray, crest: np.ndarray):
    """(ids, vectors, cluster, distance) of each stored block, in slices."""
    d = centroids.shape[1]
    for b in batches:
        for ids, kind, data, lead, rest in zip(b.column("ids"), b.column("kind").to_pylist(), b.column("data"), b.column("lead"), b.column("rest")):
            x = vectors.unpack(kind, data.as_buffer(), d).astype(np.int64)
            p, r = np.frombuffer(lead.as_buffer(), np.float64).reshape(len(x), -1), np.frombuffer(rest.as_buffer(), np.float64)
            for at in range(0, len(x), _SLICE):
                s = slice(at, at + _SLICE)
                cluster, dist, _ = nearest(x[s], p[s], r[s], centroids, cp, crest)
                yield ids.values.slice(at, _SLICE), x[s], cluster, dist


_STORED = "ids array<long>, kind string, data binary, lead binary, rest binary"


def stored(rows: DataFrame, d: int, mean: np.ndarray, lead: np.ndarray) -> DataFrame:
    """Blocks of vectors with their ids, leading rotated coordinates and residual norms, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors.matrix(b.column("q"), d)
            kind, data = vectors.pack(x)
            p, rest = filters(x, mean, lead)
            ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), b.column("vec_id"))
            yield pa.RecordBatch.from_pydict({"ids": ids, "kind": [kind], "data": pa.array([data], pa.binary()), "lead": pa.array([p.tobytes()], pa.binary()), "rest": pa.array([rest.tobytes()], pa.binary())})

    return common.materialize(rows.mapInArrow(run, _STORED), "rotated-vectors")


def moved(blocks: DataFrame, centroids: np.ndarray, mean: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The centroids after a round: componentwise floor(sum / count) of their vectors; those without any stay."""
    k, d = centroids.shape
    cp, crest = filters(centroids, mean, lead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, d + 1), np.int64)
        for _, x, cluster, _ in _assign(batches, centroids, cp, crest):
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            sums[present, :d] += np.add.reduceat(x[order], first, axis=0)
            sums[:, d] += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(k * (d + 1), dtype=np.int32)), "x": pa.array(sums.ravel())})

    new = np.zeros(k * (d + 1), np.int64)
    for r in blocks.mapInArrow(run, "at int, x long").groupBy("at").agg(F.sum("x").alias("x")).collect():  # k * (d + 1) rows
        new[r["at"]] = r["x"]
    new = new.reshape(k, d + 1)
    count = new[:, d:]
    return np.where(count > 0, new[:, :d] // np.maximum(count, 1), centroids)


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, d: int = 64, scale: int = 256, salt: str = "2", leading: int = LEADING) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of exactly ``d`` components.

    embeddings: (vec_id, embedding); other columns are ignored. Rows whose vector is null, of another length, or holds null or
    non-finite components are left out. Repeated rows count and come out as often as they stand; rows without an id are clustered
    but start no centroid. With fewer rows than ``k`` there are as many centroids as rows with an id; without any the result is
    empty. Components beyond 2 ** 27 raise an error, as do sums beyond 64 bits.
    """
    spark = embeddings.sparkSession
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = vectors.integers(embeddings, scale, d)
    centroids = starts(rows, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], out)
    mean, axes = rotation(rows, d)
    lead = axes[:, :leading]
    blocks = stored(rows, d, mean, lead)
    for _ in range(rounds):
        centroids = moved(blocks, centroids, mean, lead)
    cp, crest = filters(centroids, mean, lead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, dist in _assign(batches, centroids, cp, crest):
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(dist)})

    assigned = common.materialize(blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    per = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    side = spark.createDataFrame([(c, s, sum(per.values()), digest[c]) for c, s in sorted(per.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_clusters(spark, sf_dir):
    """Query: 40 clusters of all vectors after five rounds."""
    return cluster(common.table(spark, sf_dir, "embeddings"))
