"""The ledger: missing work by anti-join, keyed upserts, purges, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import ESTIMATE

#: Names that are put into a plan.
FEW = 1000
GENERATION_KEY = ("task_id", "model", "sample")
EVALUATION_KEY = ("task_id", "model", "sample", "evaluator_model")


def succeeded(df: DataFrame) -> Column:
    """Success; an absent flag counts as success."""
    return F.coalesce(df["success"], F.lit(True))


def scored(evaluations: DataFrame) -> DataFrame:
    return evaluations.where(succeeded(evaluations) & F.col("final_score").isNotNull())


def existing(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(succeeded(df)).select(*keys).distinct()


def missing_generations(tasks: DataFrame, models: DataFrame, generations: DataFrame) -> DataFrame:
    """(task_id, model) pairs without a successful generation. Both dimensions are small tables of names; the facts are only aggregated."""
    wanted = tasks.select("task_id").distinct().crossJoin(models.select("model").distinct())
    return wanted.join(existing(generations, "task_id", "model"), ["task_id", "model"], "left_anti")


def missing_evaluations(generations: DataFrame, evaluators: DataFrame, evaluations: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """(task_id, model, sample, evaluator_model) of successful generations that an evaluator hasn't judged; a generation's multiplicity is kept."""
    done = generations.where(succeeded(generations)).select("task_id", "model", "sample")
    if models is not None:
        done = done.join(models.select("model").distinct(), "model", "left_semi")
    names = evaluators.select("evaluator_model").distinct()
    few = [r["evaluator_model"] for r in names.limit(FEW + 1).collect()]
    listed = F.array(*map(F.lit, few)).cast("array<string>")  # judges are a handful of names; more of them are joined
    wanted = done.withColumn("evaluator_model", F.explode(listed)) if len(few) <= FEW else done.crossJoin(names)
    return wanted.join(existing(evaluations, "task_id", "model", "evaluator_model"), ["task_id", "model", "evaluator_model"], "left_anti").select("task_id", "model", "sample", "evaluator_model")


def missing_work(tasks, models, generations, evaluators, evaluations) -> DataFrame:
    """Both kinds of missing work in one list: evaluator_model is null for a generation."""
    first = missing_generations(tasks, models, generations).select(F.lit("generation").alias("kind"), "task_id", "model", F.lit(None).cast("string").alias("evaluator_model"))
    second = missing_evaluations(generations, evaluators, evaluations, models).select(F.lit("evaluation").alias("kind"), "task_id", "model", "evaluator_model")
    return first.unionByName(second)


def work_estimate(work: DataFrame) -> DataFrame:
    """Counts and estimated dollars of missing work."""
    counts = work.agg(F.count_if(F.col("kind") == "generation").alias("generations"), F.count_if(F.col("kind") == "evaluation").alias("evaluations"))
    return counts.withColumn("estimated_cost", F.col("generations") * ESTIMATE[0] + F.col("evaluations") * ESTIMATE[1])


def find(df: DataFrame, **key) -> DataFrame:
    """Point lookup: at most one row."""
    for name, value in key.items():
        df = df.where(F.col(name) == value)
    return df.limit(1)


def latest(batch: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The last record of each key in a batch."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(current: DataFrame, batch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of ``current`` that the batch doesn't name, and the batch."""
    return current.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch, allowMissingColumns=True)


def purge_failed(df: DataFrame, model: str | None = None) -> DataFrame:
    """Without failed rows, of one model if given."""
    keep = succeeded(df)
    return df.where(keep if model is None else keep | (F.col("model") != model))


def removed_count(df: DataFrame, model: str | None = None) -> DataFrame:
    """(removed): how many rows ``purge_failed`` takes away."""
    gone = ~succeeded(df)
    return df.agg(F.count_if(gone if model is None else gone & (F.col("model") == model)).alias("removed"))


def purge_models(df: DataFrame, models: DataFrame) -> DataFrame:
    """Without failed rows of the given models, so that their work is missing again; what is done before each run."""
    named = models.select("model", F.lit(True).alias("__named")).distinct()
    return df.join(named, "model", "left").where(succeeded(df) | F.col("__named").isNull()).select(*df.columns)


def planned_generations(tasks: DataFrame, models: DataFrame, generations: DataFrame, force: bool = False) -> DataFrame:
    """(task_id, model) to generate: what is missing, or with ``force`` every pair."""
    if force:
        return tasks.select("task_id").distinct().crossJoin(models.select("model").distinct())
    return missing_generations(tasks, models, generations)


def totals(generations: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Costs and counts over all rows, failed ones too."""
    g = generations.agg(F.coalesce(F.sum("generation_cost"), F.lit(0.0)).alias("generation_cost"), F.count(F.lit(1)).alias("generations"))
    e = evaluations.agg(F.coalesce(F.sum("evaluation_cost"), F.lit(0.0)).alias("evaluation_cost"), F.count(F.lit(1)).alias("evaluations"))
    return g.crossJoin(e).withColumn("total_cost", F.col("generation_cost") + F.col("evaluation_cost"))
