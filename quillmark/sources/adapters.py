"""Canonical tables out of the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import is_agentic

COMPANIES = ["anthropic", "openai", "z-ai", "acme-labs", "qwen"]
THEORIES = ["three_act", "heros_journey", "kishotenketsu", "freytag", "save_the_cat"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where the input comes in fewer parts than there are cores; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Slim rows dealt over all cores, whatever the files' row groups: of the parts that a file is read in, only those with a row group's middle get rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def model_name(key: Column) -> Column:
    m = key % 25
    return F.concat(_pick(COMPANIES, m % 5), F.lit("/model-"), F.lpad(m.cast("string"), 2, "0"))


def task_type(index: Column) -> Column:
    return _pick(K.TASK_TYPES, index % 9)


def task_id(index: Column) -> Column:
    return F.concat(task_type(index), F.lit("_"), F.lpad(index.cast("string"), 3, "0"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, tax = F.col("l_partkey") % 34, F.abs("l_tax") * 12.5
    agentic = is_agentic(F.col("task_type"))
    base = table(spark, sf_dir, "lineitem").select(
        task_id(index).alias("task_id"),
        task_type(index).alias("task_type"),
        model_name(F.col("l_suppkey")).alias("model"),
        F.concat(F.lit("judge-"), (F.col("l_linenumber") % 3).cast("string")).alias("evaluator_model"),
        F.col("l_orderkey").alias("sample"),
        (F.col("l_quantity") / 50).alias("final_score"),
        (F.col("l_extendedprice") / 1e6).alias("evaluation_cost"),
        (F.col("l_returnflag") != "R").alias("success"),
        (F.lit(1.0) - F.col("l_discount") * 10).alias("w"),
        (F.lit(1.0) - F.col("l_discount") * 5).alias("p"),
        tax.alias("j"),
    )
    single = lambda c: F.when(~agentic, F.col(c))
    scores = lambda *kv: F.when(agentic, F.create_map(*[x for k, v in kv for x in (F.lit(k), v)]))
    return base.select(
        "task_id", "task_type", "model", "evaluator_model", "sample", "final_score", "evaluation_cost", "success",
        single("w").alias("word_count_score"), single("p").alias("programmatic"), single("j").alias("llm_judge"),
        scores(("quality", F.col("w")), ("coverage", F.col("p"))).alias("process_scores"),
        scores(("satisfaction", F.col("j")), ("execution", F.col("final_score"))).alias("output_scores"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.col("o_orderkey") % 34
    return table(spark, sf_dir, "orders").select(
        task_id(index).alias("task_id"),
        task_type(index).alias("task_type"),
        model_name(F.col("o_custkey")).alias("model"),
        F.col("o_orderkey").alias("sample"),
        (F.col("o_totalprice") / 1e5).alias("generation_cost"),
        (F.col("o_orderkey") % 900 + 100).alias("prompt_tokens"),
        (F.col("o_custkey") % 3000 + 500).alias("completion_tokens"),
        (F.col("o_orderkey") % 700).alias("reasoning_tokens"),
        (F.col("o_orderstatus") != "F").alias("success"),
        F.col("o_orderdate").alias("timestamp"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each task that parts name."""
    index = F.col("p_partkey") % 34
    rows = table(spark, sf_dir, "part").select(index.alias("i")).distinct()
    return rows.select(task_id(F.col("i")).alias("task_id"), task_type(F.col("i")).alias("task_type"), _pick(THEORIES, F.col("i") % 5).alias("theory"), (F.col("i") * 10 + 200).alias("word_count_min"), (F.col("i") * 10 + 400).alias("word_count_max"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(model_name(F.col("s_suppkey")).alias("model")).distinct()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("role") == "system", "system").when(F.col("role") == "user", "question").otherwise("generation")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("generation_id"), F.col("turn").alias("turn_idx"), "role", kinds.alias("turn_type"), F.col("text").alias("content"))


def pass_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, task_type, overall_pass) of every document; unlabelled ones have no flag."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("model"), F.col("lang").alias("task_type"), (F.col("quality") == 1).alias("overall_pass"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_type") != "error").alias("success"))
