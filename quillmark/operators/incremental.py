"""Reports that are kept up to date from a ledger's changes instead of its rows.

Facts are sums and counts by key, and both can be taken back: a change feed
says which rows went and which came, and the facts of the version before plus these are the facts of
the version after. Sums are decimals, so that adding and taking away leaves no trace. Reports are made of
facts, whose number follows from the keys and not from the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of the facts of evaluations and of generations.
EVALUATION_KEYS = ("model", "task_id", "task_type", "evaluator_model")
GENERATION_KEYS = ("model", "task_id", "task_type")


def _ok() -> Column:
    return F.coalesce(F.col("success"), F.lit(True))


def _exact(x: Column) -> Column:
    """A decimal with 12 digits behind the point; numbers beyond 26 digits before it raise an error."""
    return F.coalesce(x.cast("decimal(38,12)"), F.lit(0).cast("decimal(38,12)"))


def evaluation_measures() -> dict[str, Column]:
    scored = _ok() & F.col("final_score").isNotNull()
    return {"rows": F.lit(1), "successes": _ok().cast("int"), "scored": scored.cast("int"), "score": F.when(scored, _exact(F.col("final_score"))).otherwise(_exact(F.lit(0.0))), "cost": _exact(F.col("evaluation_cost"))}


def generation_measures() -> dict[str, Column]:
    return {"rows": F.lit(1), "successes": _ok().cast("int"), "cost": _exact(F.col("generation_cost")), "tokens": F.col("prompt_tokens") + F.col("completion_tokens")}


def _typed(name: str, total: Column) -> Column:
    return total.cast("decimal(38,12)" if name in ("score", "cost") else "long").alias(name)


def facts(rows: DataFrame, keys: tuple[str, ...], measures: dict[str, Column]) -> DataFrame:
    """(keys, measures): sums of measures over all rows of each key."""
    m = rows.select(*keys, *[c.alias(n) for n, c in measures.items()])
    return m.groupBy(*keys).agg(*[_typed(n, F.sum(n)) for n in measures])


def updated(old: DataFrame, changes: DataFrame, keys: tuple[str, ...], measures: dict[str, Column]) -> DataFrame:
    """Facts after changes (before, after: structs of rows, either may be null); keys that have no row left are gone."""
    gone = changes.where("before is not null").select("before.*").select(*keys, *[(-c).alias(n) for n, c in measures.items()])
    came = changes.where("after is not null").select("after.*").select(*keys, *[c.alias(n) for n, c in measures.items()])
    total = old.select(*keys, *measures).unionByName(gone).unionByName(came).groupBy(*keys).agg(*[_typed(n, F.sum(n)) for n in measures])
    return total.where(F.col("rows") != 0)


def evaluation_report(facts: DataFrame, *by: str) -> DataFrame:
    """As ``aggregates.evaluation_report``: (by, total, successful, errors, avg_score, cost)."""
    g = facts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("rows", "successes", "scored", "score", "cost")])
    avg = F.try_divide(F.col("score").cast("double"), F.col("scored"))
    return g.select(*by, F.col("rows").alias("total"), F.col("successes").alias("successful"), (F.col("rows") - F.col("successes")).alias("errors"), avg.alias("avg_score"), F.col("cost").cast("double").alias("cost"))


def generation_report(facts: DataFrame, *by: str) -> DataFrame:
    """As ``aggregates.generation_report``: (by, total, successes, failures, cost, tokens, success_rate)."""
    g = facts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("rows", "successes", "cost", "tokens")])
    rate = F.coalesce(F.try_divide("successes", "rows"), F.lit(0.0))
    return g.select(*by, F.col("rows").alias("total"), "successes", (F.col("rows") - F.col("successes")).alias("failures"), F.col("cost").cast("double").alias("cost"), "tokens", rate.alias("success_rate"))


def status(evaluations: DataFrame, generations: DataFrame) -> DataFrame:
    """As ``aggregates.status``, of the facts of both ledgers."""
    g = generations.agg(F.array_sort(F.collect_set("model")).alias("models"), F.countDistinct("task_id").alias("tasks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("generations"), F.sum("cost").cast("double").alias("generation_cost"))
    e = evaluations.agg(F.array_sort(F.collect_set(F.when(F.col("successes") > 0, F.col("evaluator_model")))).alias("evaluators"), F.coalesce(F.sum("rows"), F.lit(0)).alias("evaluations"), F.sum("cost").cast("double").alias("evaluation_cost"))
    return g.crossJoin(e)  # one row each
