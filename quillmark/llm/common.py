"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet input tables below ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Without it only a local master gets a temporary one; on a cluster it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillmark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that were made since the last ``tidy``.
_PATHS: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    _PATHS.append(f"{shared_dir(spark)}/quillmark/{label}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def tidy(spark: SparkSession, keep: str, since: int) -> None:
    """Delete what was written on the way to the table at ``keep`` (all paths after the first ``since``), which is now the only one that later steps read."""
    for path in _PATHS[since:]:
        if path != keep:
            remove(spark, path)
    _PATHS[since:] = [keep]


def paths_made() -> int:
    return len(_PATHS)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    return materialize_at(df, label)[0]


def materialize_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``materialize``; also returns the path, for ``remove`` when no later step reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize_counted(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict, str]:
    """As ``materialize``, with metrics observed while writing; also returns the path."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get, path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_MADE: dict = {}


def per_worker(kind: type, spec: str):
    """``kind(spec)``, made once in each Python worker and kept for its later tasks; only the last spec of a kind is kept."""
    known = _MADE.get(kind)
    if known is None or known[0] != spec:
        _MADE[kind] = known = (spec, kind(spec))
    return known[1]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut into smaller ones, so that fewer Python objects live at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is tuned for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
