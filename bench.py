"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the input and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "leaderboard", "cell_breakdown", "value_ranking", "cost_efficiency", "score_matrix", "task_stats", "task_type_discrimination", "pareto_frontier", "missing_generations", "missing_evaluations",
    "upsert_latest", "ledger_totals", "pass_rates_grouping_sets", "pairwise_ttest", "word_count_scores", "repetition_score", "slop_score", "programmatic_score", "judge_score", "question_answer_pairs", "json_extract", "error_rates",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillmark.plans import catalog

    found, took = catalog.queries(), {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, wall clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
