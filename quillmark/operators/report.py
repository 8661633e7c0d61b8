"""Markdown and text from report-sized results, and the files of the full report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregates, ranking, stats
from ..functions import names


#: Rows or columns of a table that is still a report.
MOST = 1000


def percent(x: float | None) -> str:
    return "-" if x is None else f"{x:.1%}"


def money(x: float | None) -> str:
    return "-" if x is None else f"${x:.4f}"


def number(x: int | None) -> str:
    """With thousands separators."""
    return "-" if x is None else f"{x:,}"


def markdown_table(df: DataFrame, formats: dict | None = None, most: int = MOST) -> str:
    """A report-sized DataFrame as a Markdown table; null shows as a hyphen. More than ``most`` rows are no report and raise an error."""
    formats = formats or {}
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    show = lambda c, v: formats[c](v) if c in formats else "-" if v is None else str(v)
    head = [f"| {' | '.join(df.columns)} |", f"|{'|'.join('---' for _ in df.columns)}|"]
    return "\n".join(head + [f"| {' | '.join(show(c, r[c]) for c in df.columns)} |" for r in rows])


def leaderboard_markdown(ranked: DataFrame, values: DataFrame) -> str:
    columns = ["rank", "model_short", "company", "avg_score", "generation_cost"]
    formats = {"avg_score": percent, "generation_cost": money, "value": "{:.1f}".format}
    best = markdown_table(values.orderBy("rank").select("rank", "model", "value"), formats)
    return f"# Leaderboard\n\n{markdown_table(ranked.orderBy('rank').select(*columns), formats)}\n\n## Best value\n\n{best}\n"


def task_analysis_markdown(task_stats: DataFrame, cells: DataFrame) -> str:
    """Task types by discrimination, the ten most discriminative, hardest and easiest tasks, costs, every task, and scores by model."""
    shares = {c: percent for c in ("avg_score", "avg_spread", "max_spread", "spread", "min_score", "max_score")}
    formats = shares | {"total_cost": money, "avg_cost": money, "stdev": "{:.2f}".format}
    t = task_stats.withColumn("best_model", names.short_name(F.col("best_model"))).withColumn("worst_model", names.short_name(F.col("worst_model")))
    parts = ["# Task analysis", "## Discrimination by task type", markdown_table(aggregates.discrimination(t).orderBy(ranking.settled("avg_spread").desc(), "task_type"), formats)]
    for title, by, up in (("Most discriminative tasks", "spread", False), ("Hardest tasks", "avg_score", True), ("Easiest tasks", "avg_score", False)):
        top = ranking.top_tasks(t, by, 10, up).orderBy("rank").select("rank", "task_id", "task_type", "spread", "avg_score", "best_model", "worst_model")
        parts += [f"## {title}", markdown_table(top, formats)]
    every = t.orderBy("task_type", ranking.settled("spread").desc(), "task_id").select("task_type", "task_id", "theory", "avg_score", "min_score", "max_score", "spread", "stdev", "best_model", "worst_model")
    parts += ["## Every task", markdown_table(every, formats), "## Costs", markdown_table(aggregates.task_type_costs(t).orderBy("task_type"), formats)]
    models = [r.model for r in cells.select("model").distinct().orderBy("model").limit(MOST + 1).collect()]
    if len(models) > MOST:
        raise ValueError(f"more than {MOST} models for a report")
    scores = ranking.matrix(cells, "task_id", "model", "score", models).orderBy("task_id")
    parts += ["## Scores by task and model", markdown_table(scores, {m: percent for m in models})]
    return "\n\n".join(parts) + "\n"


def insights(rates: DataFrame) -> DataFrame:
    """(insight, task_type, pass_rate, best_model, worst_model, gap): weakest and strongest task types, and where models differ most."""
    ends = ranking.extreme_types(rates).select(F.concat("end", F.lit("_task_type")).alias("insight"), "task_type", F.col("rate").alias("pass_rate"))
    gaps = ranking.model_gaps(rates).select(F.lit("model_gap").alias("insight"), "task_type", "best_model", "worst_model", "gap")
    return ends.unionByName(gaps, allowMissingColumns=True)


def write_report(out: str, flags: DataFrame, evaluations: DataFrame, generations: DataFrame, tasks: DataFrame) -> None:
    """The full report below ``out``: aggregated pass rates, statistical comparisons and insights as JSON lines, leaderboard and task analysis as Markdown text."""
    spark = evaluations.sparkSession
    rates, cells = aggregates.pass_rates(flags), aggregates.cell_scores(evaluations)
    compared = stats.with_p_values(stats.pairwise(cells)).select("model_a", "model_b", "t", "p", "significant", "cohens_d", "effect")
    for name, df in {"aggregated_scores": rates, "statistical_comparisons": compared, "insights": insights(rates)}.items():
        df.coalesce(1).write.mode("overwrite").json(f"{out}/{name}")
    summary = aggregates.summary(evaluations, generations)
    texts = {"leaderboard": leaderboard_markdown(ranking.leaderboard(summary), ranking.value_ranking(summary)), "task_analysis": task_analysis_markdown(aggregates.task_stats(cells, tasks, generations), cells)}
    for name, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{name}")


def summary_rows(summary: DataFrame, type_scores: DataFrame) -> DataFrame:
    """(part, place, name, score_pct, cost) with display names: every model under "ranking" by its rank, and under "best" the best model of each task type; a score of 0 is shown as none."""
    ranked = ranking.leaderboard(summary)
    name = names.display_name(F.col("model")).alias("name")
    score = F.when(F.col("avg_score") != 0, F.col("avg_score") * 100)
    models = ranked.select(F.lit("ranking").alias("part"), F.col("rank").cast("string").alias("place"), name, score.alias("score_pct"), F.col("generation_cost").alias("cost"))
    best = ranking.best_by_type(type_scores, ranked).select(F.lit("best").alias("part"), F.col("task_type").alias("place"), name, score.alias("score_pct"))
    return models.unionByName(best, allowMissingColumns=True)


def console_summary(summary: DataFrame, type_scores: DataFrame, evaluators: list[str]) -> str:
    """The summary as Markdown: who judged, the ranking, and the best model of each task type. More models than a table holds raise an error."""
    rows = summary_rows(summary, type_scores)
    formats = {"score": lambda x: "N/A" if x is None else f"{x:.1f} %", "cost": money}
    shown = lambda part, order, first: rows.where(F.col("part") == part).orderBy(order).select(F.col("place").alias(first), "name", F.col("score_pct").alias("score"), *(["cost"] if part == "ranking" else []))
    judges = ", ".join(e.split("/")[-1] for e in evaluators) or "-"
    tables = [markdown_table(shown("ranking", F.col("place").cast("int"), "rank"), formats), markdown_table(shown("best", F.col("place"), "task_type"), formats)]
    return f"# Summary\n\nJudged by {judges}.\n\n## Ranking\n\n{tables[0]}\n\n## Best model of each task type\n\n{tables[1]}\n"
