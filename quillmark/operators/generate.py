"""Side-effecting steps: model calls over a work list, with an injected client and a durable log of requests.

A client factory is called once in each task; the client takes a prompt and
returns (text, prompt tokens, completion tokens). Failures are retried with
doubling delays and end as failed rows, never as failed jobs, so a later run
finds them in the missing work.

``call_once`` writes what a task got when the task ends, even if the job then
dies, and only asks what the log doesn't hold. So a run that starts again
repeats at most the calls of tasks that hadn't ended.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ingest import load_or_empty

Client = Callable[[str], tuple[str, int, int]]
RESULT = "output string, prompt_tokens long, completion_tokens long, success boolean, error string, attempts int"
_KEY = ("generation_id", "round", "prompt_sha")
_LOG = f"generation_id string, round int, prompt_sha string, {RESULT}"


def stub_client() -> Client:
    """A deterministic client for tests: it answers with the prompt's words in reverse."""

    def call(prompt: str) -> tuple[str, int, int]:
        words = prompt.split()
        if "fail" in words:
            raise RuntimeError("asked to fail")
        return " ".join(reversed(words)), len(words), len(words)

    return call


def with_retry(call: Client, prompt: str, tries: int, delay: float) -> tuple:
    for n in range(1, tries + 1):
        try:
            return (*call(prompt), True, None, n)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if n < tries:
                time.sleep(delay * 2 ** (n - 1))
    return ("", 0, 0, False, error, tries)


def call_model(work: DataFrame, client: Callable[[], Client], prompt: str = "prompt", tries: int = 3, delay: float = 1.0) -> DataFrame:
    """``work`` with the result columns for its prompt column; null prompts fail."""
    names = work.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for pdf in batches:
            got = [with_retry(call, p, tries, delay) if p is not None else ("", 0, 0, False, "no prompt", 0) for p in pdf[prompt]]
            extra = pd.DataFrame(got, columns=["output", "prompt_tokens", "completion_tokens", "success", "error", "attempts"])
            yield pd.concat([pdf[names].reset_index(drop=True), extra], axis=1)

    ddl = ", ".join([f"`{n}` {t}" for n, t in work.dtypes] + [RESULT])
    return work.mapInPandas(run, ddl)


def logged(spark: SparkSession, log: str, round_: int) -> DataFrame:
    """The answers of a round in a request log, one for each request; a success comes before a failure."""
    rows = load_or_empty(spark, f"{log}/round={round_}", _LOG)
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in _KEY]), F.struct("success", "output"))
    return rows.groupBy(*_KEY).agg(best.alias("r")).select(*_KEY, "r.*")


def call_once(requests: DataFrame, client: Callable[[], Client], log: str, round_: int = 0, tries: int = 3, delay: float = 1.0, calls_per_task: int = 32, retry_failed: bool = False) -> DataFrame:
    """(generation_id, output, prompt_tokens, completion_tokens, success, error, attempts) of requests (generation_id, prompt); each is asked once.

    What the log holds for the same round, generation_id and prompt isn't asked again, unless it failed and ``retry_failed`` is
    set. A task asks about ``calls_per_task`` requests and its answers are in the log once it ends. A repeated request counts once.
    """
    spark = requests.sparkSession
    asked = requests.select(F.col("generation_id").cast("string").alias("generation_id"), F.lit(round_).alias("round"), F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("prompt_sha"), "prompt").dropDuplicates(list(_KEY))
    done = logged(spark, log, round_)
    todo = asked.join(done.where("success") if retry_failed else done, list(_KEY), "left_anti")
    n = todo.count()
    if n:
        answers = call_model(todo.repartition(-(-n // calls_per_task), *_KEY), client, "prompt", tries, delay).drop("prompt")
        # with this commit protocol a task's file stays when a later task ends the job
        answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{log}/round={round_}")
    return logged(spark, log, round_).join(asked.select(*_KEY), list(_KEY), "left_semi").drop("round", "prompt_sha")


def log_folder(spark: SparkSession) -> str:
    """A new folder for a request log below the folder that all executors share (``spark.checkpoint.dir``)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        raise ValueError("a log needs a path, or spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/quillmark/requests-{uuid.uuid4().hex}"


def conversation(work: DataFrame, client: Callable[[], Client], rounds: int, follow_up: Callable[[Column, int], Column], tries: int = 3, delay: float = 1.0, log: str | None = None, calls_per_task: int = 32) -> DataFrame:
    """Rounds of calls: each round's prompt is a column expression of the last answer; every call is made once and is in the log.

    Returns (generation_id, turn_idx, role, turn_type, content, success); a conversation stops at its first failure.
    """
    log = log or log_folder(work.sparkSession)
    now, out = work.select("generation_id", "prompt"), None
    for r in range(rounds):
        done = now.join(call_once(now, client, log, r, tries, delay, calls_per_task), "generation_id")
        turns = done.select("generation_id", F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.lit("question").alias("turn_type"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("generation").alias("turn_type"), F.col("output").alias("content")))).alias("k", "t"), "success")
        turns = turns.select("generation_id", (F.col("k") + 2 * r).alias("turn_idx"), "t.*", "success")
        out = turns if out is None else out.unionByName(turns)
        now = done.where("success").select("generation_id", follow_up(F.col("output"), r).alias("prompt"))
    return out


def evaluator_costs(evaluations: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Evaluations with their cost from tokens and a price table (evaluator_model, price_in, price_out) of a few models; unknown ones cost the default."""
    p = evaluations.join(prices, "evaluator_model", "left")
    cost = F.col("prompt_tokens") / 1e6 * F.coalesce("price_in", F.lit(default[0])) + F.col("completion_tokens") / 1e6 * F.coalesce("price_out", F.lit(default[1]))
    return p.withColumn("evaluation_cost", cost).drop("price_in", "price_out")
