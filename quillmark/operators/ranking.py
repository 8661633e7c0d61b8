"""Rankings, frontiers, matrices and chart-ready views; ranks and frontiers are made in ranges of the order, whatever the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions.constants import CHART_COMPANY_NAMES, TASK_TYPES
from .ordering import with_row_number, with_running_max


def settled(column) -> Column:
    """A mean as a sort key: differences below 1e-12 come from the order of summation and count as ties."""
    return F.round(F.col(column) if isinstance(column, str) else column, 12)


def leaderboard(summary: DataFrame) -> DataFrame:
    """Models by mean score (null counts as 0), then name; one row for each model."""
    ranked = with_row_number(summary, -settled(F.coalesce("avg_score", F.lit(0.0))), "model")
    return ranked.withColumn("model_short", names.short_name(F.col("model"))).withColumn("company", names.company_name(F.col("model")))


def value_ranking(summary: DataFrame) -> DataFrame:
    """Squared score per dollar, for models with a score and a cost."""
    v = summary.where(F.col("avg_score").isNotNull() & (F.col("generation_cost") > 0)).withColumn("value", F.col("avg_score") * F.col("avg_score") * 100 / F.col("generation_cost"))
    return with_row_number(v, -settled("value"), "model")


def top_tasks(stats: DataFrame, by: str, k: int = 10, ascending: bool = False) -> DataFrame:
    """The k first tasks by a statistic, with their rank."""
    key = settled(by).asc() if ascending else settled(by).desc()
    best = stats.orderBy(key, "task_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(key, "task_id")))


def details(stats: DataFrame) -> DataFrame:
    """Tasks inside their type by falling spread."""
    return stats.withColumn("place", F.row_number().over(Window.partitionBy("task_type").orderBy(settled("spread").desc(), "task_id")))


def best_by_type(type_scores: DataFrame, ranked: DataFrame) -> DataFrame:
    """Best model of each task type with a score above 0; ties go to the better overall rank."""
    t = type_scores.where("avg_score > 0").join(ranked.select("model", "rank"), "model")
    first = Window.partitionBy("task_type").orderBy(settled("avg_score").desc(), "rank")
    return t.withColumn("__r", F.row_number().over(first)).where("__r = 1").select("task_type", "model", "avg_score")


def extreme_types(rates: DataFrame, k: int = 2) -> DataFrame:
    """The k task types with the least and the k with the highest pass rate; with fewer than 2 k types some stand at both ends."""
    low, high = F.row_number().over(Window.orderBy("rate", "task_type")), F.row_number().over(Window.orderBy(F.desc("rate"), F.desc("task_type")))
    t = rates.where("scope = 'task_type'").select("task_type", "rate").withColumn("low", low).withColumn("high", high)
    ends = F.array_compact(F.array(F.when(F.col("low") <= k, "weakest"), F.when(F.col("high") <= k, "strongest")))
    return t.select("task_type", "rate", F.explode(ends).alias("end"))


def model_gaps(rates: DataFrame, least: float = 0.15) -> DataFrame:
    """Task types on which models differ most: the gap between the best and the worst pass rate."""
    m = rates.where("scope = 'model_task_type'")
    order = lambda s: F.array_sort(F.collect_list(F.struct((F.col("rate") * s).alias("r"), "model")))[0]["model"]
    g = m.groupBy("task_type").agg(F.count(F.lit(1)).alias("models"), (F.max("rate") - F.min("rate")).alias("gap"), order(-1).alias("best_model"), order(1).alias("worst_model"))
    return g.where((F.col("models") >= 2) & (F.col("gap") > least))


def frontier(points: DataFrame, cost: str = "generation_cost", score: str = "avg_score") -> DataFrame:
    """Points with ``on_frontier``: nothing cheaper scores as high."""
    p = with_running_max(points, settled(cost), settled(score), settled(score).desc(), "model", name="__b")
    return p.withColumn("on_frontier", F.col("__b").isNull() | (settled(score) > F.col("__b"))).drop("__b")


def marker_sizes(points: DataFrame, by: str = "total_tokens") -> DataFrame:
    """Minimum-maximum scaling to 50..150; 100 where all are equal."""
    ends = points.agg(F.min(by).alias("__low"), F.max(by).alias("__high"))  # each task sends one row
    low, high = F.col("__low"), F.col("__high")
    marker = F.when(high == low, 100.0).otherwise(F.try_divide((F.col(by) - low) * 100.0, high - low) + 50)
    return points.crossJoin(F.broadcast(ends)).withColumn("marker", marker).drop("__low", "__high")


def matrix(long: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """A pivot with a fixed list of columns; missing cells are null."""
    return long.groupBy(row).pivot(column, columns or TASK_TYPES).agg(F.first(value))


def heat_map(long: DataFrame, row: str, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    """The matrix in per cent with 0 for missing cells."""
    m = matrix(long, row, column, value, columns)
    return m.select(row, *[(F.coalesce(F.col(c), F.lit(0.0)) * 100).alias(c) for c in m.columns if c != row])


def cost_score_points(summary: DataFrame) -> DataFrame:
    """Chart points: score in per cent, cost, tokens, company, marker size, frontier flag."""
    p = summary.where("generation_cost > 0").withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    p = frontier(marker_sizes(p))
    return p.select("model", names.display_name(F.col("model")).alias("name"), names.company_name(F.col("model"), CHART_COMPANY_NAMES).alias("company"), (F.col("avg_score") * 100).alias("score_pct"), "generation_cost", "total_tokens", "marker", "on_frontier")


def contributions(components: DataFrame) -> DataFrame:
    """Stacked parts: half of each component in per cent."""
    part = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) * 50).alias(c.removeprefix("avg_") + "_part")
    return components.select("model", part("avg_programmatic"), part("avg_llm_judge"))
