"""Medians of groups of any size."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import aggregates, selection


def plain(rows):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return {k: (statistics.median(v), len(v)) for k, v in groups.items()}


CASES = {
    "ties": [("a", 0.5)] * 40 + [("a", 0.25)] * 39 + [("b", 1.0)],
    "even": [("a", float(i)) for i in range(10)] + [(None, 3.0), (None, 4.0)],
    "odd": [("a", float(i) ** 3) for i in range(-8, 9)] + [("b", None), ("c", -0.0), ("c", 0.0)],
    "wide": [("a", x) for x in (-1.7e308, 1.7e308, 1.0, 2.0, 3.0, 1e-300, -1e-300)],
    "skewed": [("hot", 2.0**-i) for i in range(60)] + [("hot", 0.0)] * 7 + [("cold", 7.0)],
    "infinite": [("a", float("inf"))] * 3 + [("a", float("-inf"))] * 3 + [("a", 1.0)] * 3,
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("rounds, parts", [(2, 4096), (1, 4), (0, 4), (3, 2)])
def test_range_medians(spark, case, rounds, parts):
    df = spark.createDataFrame(CASES[case], "k string, v double").repartition(3)
    got = {r.k: (r.median, r.n) for r in selection.by_ranges(df, ("k",), "v", rounds, parts).collect()}
    assert got == plain(CASES[case])
    if case != "infinite":
        assert {r.k: (r.median, r.n) for r in selection.buffered(df, ("k",), "v").collect()} == got


def test_a_cell_of_millions_of_different_values(spark):
    """Ten million different values in one cell: tasks hold counts, so the plan has no buffered percentile and a small memory is enough."""
    n = 10_000_000
    df = spark.range(n, numPartitions=8).select(F.lit("m").alias("model"), F.lit("t_1").alias("task_id"), F.lit("t").alias("task_type"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 3.0).alias("final_score"), F.lit(True).alias("success"))
    cells = aggregates.cell_scores(df)
    assert "percentile" not in cells._jdf.queryExecution().optimizedPlan().toString()
    (r,) = cells.collect()
    assert r.score == pytest.approx((n - 1) / 2 / 3.0, rel=1e-12) and r.evaluations == n


def test_the_buffer_is_proven(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("double").alias("v"))
    assert selection.fits_buffer(df, "v", 1000) and selection.fits_buffer(df, "v", 200) and not selection.fits_buffer(df, "v", 20)
    assert np.isclose(selection.medians(df.withColumn("k", F.lit(1)), ("k",), "v", 20).first().median, 24.5)
