"""Scores and costs at every level: cell, model, task, task type.

Cells are (model, task) pairs: the median over evaluators, then means over
cells. All are grouped aggregates on keys with few values, so they combine
map-side. Medians are exact: over (value, count) pairs where a cell's
different values have a proven bound, else by range counting (``selection``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.judge import map_mean
from ..functions.names import output_tokens
from . import selection
from .ledger import scored, succeeded

CELL = ("model", "task_id", "task_type")
COMPONENTS = ("word_count", "programmatic", "llm_judge")


def cell_scores(evaluations: DataFrame) -> DataFrame:
    """(model, task_id, task_type, score, evaluations): median of successful, scored evaluations."""
    return selection.medians(scored(evaluations), CELL, "final_score").select(*CELL, F.col("median").alias("score"), F.col("n").alias("evaluations"))


def cell_breakdown(evaluations: DataFrame) -> DataFrame:
    """Medians of score components; if any evaluation of a cell is multi-turn, only those count, and the judge is their output mean.

    Columns: model, task_id, task_type, word_count, programmatic, llm_judge, process, output. Each component is counted apart, so that
    equal values combine before the shuffle.
    """
    e = scored(evaluations)
    agentic = F.col("output_scores").isNotNull()
    parts = {c: F.when(~agentic, F.coalesce(F.col(c), F.lit(0.0))) for c in ("word_count_score", "programmatic", "llm_judge")}
    parts |= {"process": map_mean(F.col("process_scores")), "output": map_mean(F.col("output_scores")), "agentic": F.when(agentic, 1.0)}
    long = e.select(*CELL, F.inline(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in parts.items()]))).where("value is not null")
    medians = selection.medians(long, (*CELL, "part"), "value")
    g = medians.groupBy(*CELL).agg(*[F.max(F.when(F.col("part") == k, F.col("median"))).alias(k) for k in parts])
    is_agentic = F.col("agentic").isNotNull()
    single = lambda c: F.when(~is_agentic, F.col(c))
    return g.select("model", "task_id", "task_type", single("word_count_score").alias("word_count"), single("programmatic").alias("programmatic"), F.when(is_agentic, F.col("output")).otherwise(F.col("llm_judge")).alias("llm_judge"), F.when(is_agentic, F.col("process")).alias("process"), F.when(is_agentic, F.col("output")).alias("output"))


def model_scores(cells: DataFrame, *by: str) -> DataFrame:
    """Mean over tasks of cell scores, by model (and more keys)."""
    return cells.groupBy("model", *by).agg(F.avg("score").alias("avg_score"), F.count("score").alias("total"))


def model_components(breakdown: DataFrame, *by: str) -> DataFrame:
    """Mean of each component over the cells that have it."""
    return breakdown.groupBy("model", *by).agg(*[F.avg(c).alias(f"avg_{c}") for c in COMPONENTS])


def model_costs(generations: DataFrame) -> DataFrame:
    """Sums over successful generations by model."""
    tokens = ("prompt_tokens", "completion_tokens", "reasoning_tokens")
    sums = [F.sum(c).alias(c) for c in tokens]
    g = generations.where(succeeded(generations)).groupBy("model").agg(F.sum("generation_cost").alias("generation_cost"), F.count(F.lit(1)).alias("generations"), *sums)
    return g.withColumn("output_tokens", output_tokens(F.col("completion_tokens"), F.col("reasoning_tokens"))).withColumn("avg_cost_per_task", F.coalesce(F.try_divide("generation_cost", "generations"), F.lit(0.0)))


def summary(evaluations: DataFrame, generations: DataFrame) -> DataFrame:
    """Model scores with costs; models without generations cost 0."""
    out = model_scores(cell_scores(evaluations)).join(model_costs(generations), "model", "left")
    return out.na.fill(0, ["generation_cost", "generations", "prompt_tokens", "completion_tokens", "reasoning_tokens", "output_tokens", "avg_cost_per_task"])


def cost_efficiency(costs: DataFrame) -> DataFrame:
    """Output tokens, share of reasoning, dollars per thousand output tokens."""
    share = F.when(F.col("completion_tokens") > 0, F.col("reasoning_tokens") * 100.0 / F.col("completion_tokens")).otherwise(0.0)
    per_1k = F.when(F.col("output_tokens") > 0, F.col("generation_cost") / F.col("output_tokens") * 1000).otherwise(0.0)
    return costs.select("model", "output_tokens", share.alias("reasoning_pct"), per_1k.alias("cost_per_1k_output"))


def _end(best: bool, name: str) -> Column:
    """Model at an end of the scores; ties go to the first name."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("score") if best else F.col("score")).alias("s"), "model")))
    return order[0]["model"].alias(name)


def task_stats(cells: DataFrame, tasks: DataFrame, generations: DataFrame) -> DataFrame:
    """Spread of models' scores on each task, best and worst model, costs; task attributes fall back to the fact's own.

    A task has one score for each model, so a task's group is as large as the number of models.
    """
    g = cells.groupBy("task_id").agg(
        F.first("task_type").alias("fact_type"), F.count("score").alias("models_evaluated"), F.sum("evaluations").alias("evaluations_count"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"),
        F.max("score").alias("max_score"), (F.max("score") - F.min("score")).alias("spread"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("stdev"), _end(True, "best_model"), _end(False, "worst_model"),
    )
    cost = task_costs(generations)
    dim = tasks.select("task_id", F.col("task_type").alias("dim_type"), "theory")
    out = g.join(dim, "task_id", "left").join(cost, "task_id", "left")
    return out.select("task_id", F.coalesce("dim_type", "fact_type").alias("task_type"), F.coalesce("theory", F.lit("Unknown")).alias("theory"), *[c for c in g.columns if c not in ("task_id", "fact_type")], F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"), F.coalesce("avg_cost", F.lit(0.0)).alias("avg_cost"))


def task_costs(generations: DataFrame) -> DataFrame:
    return generations.where(succeeded(generations)).groupBy("task_id").agg(F.sum("generation_cost").alias("total_cost"), F.avg("generation_cost").alias("avg_cost"))


def discrimination(stats: DataFrame) -> DataFrame:
    """Task types by how well their tasks tell models apart."""
    g = stats.groupBy("task_type").agg(F.count(F.lit(1)).alias("tasks"), F.avg("avg_score").alias("avg_score"), F.avg("spread").alias("avg_spread"), F.max("spread").alias("max_spread"))
    rating = F.when(F.col("avg_spread") >= 0.20, "Excellent").when(F.col("avg_spread") >= 0.15, "Good").when(F.col("avg_spread") >= 0.10, "Moderate").otherwise("Low")
    return g.withColumn("rating", rating)


def task_type_costs(stats: DataFrame) -> DataFrame:
    return stats.groupBy("task_type").agg(F.sum("total_cost").alias("total_cost"), F.avg("avg_cost").alias("avg_cost"))


def pass_rates(flags: DataFrame) -> DataFrame:
    """Pass rates by model, by task type, by both and over all, in one pass; an absent flag fails, absent keys are "unknown"."""
    passed = F.coalesce("overall_pass", F.lit(False)).cast("int")
    f = flags.select(F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("task_type", F.lit("unknown")).alias("task_type"), passed.alias("p"))
    sets = [(F.col("model"),), (F.col("task_type"),), (F.col("model"), F.col("task_type")), ()]
    g = f.groupingSets([list(s) for s in sets], "model", "task_type").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("p").alias("passed"), F.avg("p").alias("rate"), F.coalesce(F.var_pop("p"), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_pop("p"), F.lit(0.0)).alias("std")
    )
    return g.withColumn("scope", F.element_at(F.array(*map(F.lit, ("model_task_type", "model", "task_type", "overall"))), (F.col("level") + 1).cast("int"))).drop("level")


def evaluation_report(evaluations: DataFrame, *by: str) -> DataFrame:
    """Totals, errors, mean score and cost of evaluations."""
    ok = succeeded(evaluations)
    return evaluations.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("errors"), F.avg(F.when(ok, F.col("final_score"))).alias("avg_score"), F.sum("evaluation_cost").alias("cost"))


def generation_report(generations: DataFrame, *by: str) -> DataFrame:
    """Totals, success rate, cost and tokens of generations."""
    ok = succeeded(generations)
    g = generations.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.sum("generation_cost").alias("cost"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))
    return g.withColumn("success_rate", F.coalesce(F.try_divide("successes", "total"), F.lit(0.0)))


def status(evaluations: DataFrame, generations: DataFrame) -> DataFrame:
    """Distinct models, tasks and evaluators, and what they cost."""
    g = generations.agg(F.array_sort(F.collect_set("model")).alias("models"), F.countDistinct("task_id").alias("tasks"), F.count(F.lit(1)).alias("generations"), F.sum("generation_cost").alias("generation_cost"))
    e = evaluations.agg(F.array_sort(F.collect_set(F.when(succeeded(evaluations), F.col("evaluator_model")))).alias("evaluators"), F.count(F.lit(1)).alias("evaluations"), F.sum("evaluation_cost").alias("evaluation_cost"))
    return g.crossJoin(e)
