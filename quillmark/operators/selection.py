"""Exact medians of groups of any size.

A buffered median holds a group's different values in one task. Where they
may be too many, ranks are found by repeated range counting: each round cuts
the range that holds a rank into equal parts, counts the rows of each part
where they are read, and keeps the part with the rank. A task holds counts, never values, and a group that has most of
the rows is counted by all tasks. What is left after the rounds is a small share of the different values, which are
sorted, externally if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Different values that a buffered median may hold; parts of a range and rounds of counting.
BUFFER, PARTS, ROUNDS = 1_000_000, 4096, 2


def fits_buffer(rows: DataFrame, value: str, buffer: int = BUFFER) -> bool:
    """Whether no group can have more different values than the buffer holds: by the number of rows, else by an estimate of all different values."""
    if rows.select(F.lit(1)).count() <= buffer:
        return True
    return rows.agg(F.approx_count_distinct(value).alias("d")).first()["d"] <= buffer // 2  # the estimate errs by 5 %


def buffered(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, median, n): over (value, count) pairs that combine before the shuffle."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*keys).agg(F.percentile(value, F.lit(0.5), F.col("__n")).alias("median"), F.sum("__n").alias("n"))


def _same(keys: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(f"r.{k}").eqNullSafe(F.col(f"t.__k{i}"))
    return out


def by_ranges(rows: DataFrame, keys: tuple[str, ...], value: str, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """(keys, median, n), equal to ``buffered`` but with bounded memory; NaN counts as the greatest value and null not at all."""
    x = F.col("__x")
    r = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    ids = [f"__k{i}" for i in range(len(keys))]
    n = F.col("__n")
    middle = F.array(F.struct(F.lit(0).alias("which"), F.expr("(__n - 1) div 2").alias("rank")), F.struct(F.lit(1).alias("which"), F.expr("__n div 2").alias("rank")))
    targets = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("low"), F.max("__x").alias("high")).select(*named, n, "low", "high", middle.alias("ranks"))
    group = [*ids, "__n", "low", "high", "ranks"]
    before = lambda of: F.coalesce(F.sum("m").over(Window.partitionBy(*group).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def inside() -> DataFrame:
        return r.alias("r").join(targets.alias("t"), _same(keys) & (x >= F.col("low")) & (x <= F.col("high"))).select("t.*", "__x")

    def holding(counted: DataFrame, of: str) -> DataFrame:
        """The part that holds each rank, and the rank inside it."""
        c = counted.withColumn("before", before(of)).withColumn("k", F.explode("ranks"))
        return c.where((F.col("k.rank") >= F.col("before")) & (F.col("k.rank") < F.col("before") + F.col("m")))

    for _ in range(rounds):
        # halves, so that a range wider than the greatest double has a width
        share = (x / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        part = F.when((F.col("high") > F.col("low")) & ~F.isnan("high"), F.least(F.floor(share * parts), F.lit(parts - 1))).otherwise(F.when(F.isnan("__x"), 1).otherwise(0))
        counted = inside().withColumn("part", part).groupBy(*group, "part").agg(F.count(F.lit(1)).alias("m"), F.min("__x").alias("least"), F.max("__x").alias("most"))
        held = holding(counted, "part").select(*ids, "__n", "least", "most", F.struct(F.col("k.which").alias("which"), (F.col("k.rank") - F.col("before")).alias("rank")).alias("k"))
        targets = held.groupBy(*ids, "__n", F.col("least").alias("low"), F.col("most").alias("high")).agg(F.sort_array(F.collect_list("k")).alias("ranks"))
    counted = inside().groupBy(*group, "__x").agg(F.count(F.lit(1)).alias("m"))
    found = holding(counted, "__x").groupBy(*ids, "__n").agg(F.max(F.when(F.col("k.which") == 0, x)).alias("lower"), F.max(F.when(F.col("k.which") == 1, x)).alias("upper"))
    median = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(F.col("lower") * 0.5 + F.col("upper") * 0.5)
    return found.select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], median.alias("median"), n.alias("n"))


def medians(rows: DataFrame, keys: tuple[str, ...], value: str, buffer: int = BUFFER) -> DataFrame:
    """(keys, median, n) of each group's values that aren't null: buffered where the buffer has a proven bound, else by range counting."""
    return buffered(rows, keys, value) if fits_buffer(rows, value, buffer) else by_ranges(rows, keys, value)
