"""Integer vectors: quantised components, and blocks of them that tasks read without parsing rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest absolute component for which sums of squared differences over 64 dimensions stay below 2 ** 63.
LIMIT = 1 << 27
_KINDS = ("int8", "int16", "int32", "int64")


def integers(vectors: DataFrame, scale: int = 256, d: int | None = None) -> DataFrame:
    """(vec_id, q array<long>): floor(scale * x) of each component of vectors without null or non-finite ones, of length ``d`` if given.

    Null ids stay. Components beyond 64 bits come out as the nearest long, which ``matrix`` refuses.
    """
    x = F.col("embedding")
    fits = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fits if d is None else fits & (F.size(x) == d))
    return good.select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("q"))


def matrix(column: pa.ListArray, d: int, limit: int = LIMIT) -> np.ndarray:
    """The rows of a list column as an int64 matrix; components beyond ``limit`` raise an error, since sums of their squares may not fit a long."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    if x.size and max(int(x.max()), -int(x.min())) > limit:
        raise OverflowError(f"a quantised component is beyond {limit}")
    return x


def pack(x: np.ndarray) -> tuple[str, bytes]:
    """(kind, bytes) of an integer matrix in the narrowest integers that hold it."""
    kind = next(k for k in _KINDS if not x.size or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
    return kind, x.astype(kind).tobytes()


def unpack(kind: str, data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, d)


def blocks(rows: DataFrame, d: int, limit: int = LIMIT) -> DataFrame:
    """(n, kind, data): the vectors of ``rows`` (q array<long> of length d) in blocks of an Arrow batch each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                kind, data = pack(matrix(b.column("q"), d, limit))
                yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "kind": [kind], "data": pa.array([data], pa.binary())})

    return rows.select("q").mapInArrow(run, "n long, kind string, data binary")


def each_block(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for b in batches:
        for kind, data in zip(b.column("kind").to_pylist(), b.column("data")):
            yield unpack(kind, data.as_buffer(), d)
