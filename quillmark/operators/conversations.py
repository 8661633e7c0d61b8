"""Multi-turn conversations as rounds of calls over a table: discovery, plan and execution, revision, critique.

A conversation is a row: its work columns, its turns so far, whether it is
still going on. A ``Call`` says what is said before a model answers, and
what the answer becomes, as column expressions. ``run`` makes one call of every
conversation at a time, through the request log, and writes the table after
each, so that a run that starts again goes through the answers it has, asks nothing
twice and plans no longer queries as rounds go by.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from . import generate

_TURNS = "array<struct<role:string,turn_type:string,content:string>>"


def turn(role: str, turn_type: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(turn_type).alias("turn_type"), content.cast("string").alias("content"))


@dataclass(frozen=True)
class Call:
    """One model call of every conversation that ``when`` holds for.

    before and after are array<struct<role, turn_type, content>> columns over the row (its work columns and ``turns``); after and
    ``said`` also see the answer as ``answer``. ``messages`` replaces what the model is shown, else it is shown all turns.
    """

    turn_type: str
    role: str = "assistant"
    client: Callable[[], generate.Client] | None = None
    when: Column | None = None
    before: Column | None = None
    said: Column | None = None
    after: Column | None = None
    messages: Column | None = None


def callable_oracle(answer: Callable[[str], str]) -> Callable[[Column], Column]:
    """An oracle that is a Python function of the question, as a function of columns; its errors fail the job, so it should answer whatever it is asked."""

    @F.pandas_udf("string")
    def run(questions: pd.Series) -> pd.Series:
        return questions.map(lambda q: None if q is None else answer(q))

    return run


def _none() -> Column:
    return F.array().cast(_TURNS)


def run(work: DataFrame, client: Callable[[], generate.Client], calls: list[Call], log: str | None = None, opening: Column | None = None, tries: int = 3, delay: float = 1.0, calls_per_task: int = 32) -> DataFrame:
    """``work`` (generation_id, any columns) with turns, output, prompt_tokens, completion_tokens, calls, success and error.

    ``opening`` is the array of turns that a conversation starts with. A conversation ends at its first failed call, and one whose last
    generation is blank has failed. generation_ids must be different and not null: others raise an error. An empty work list gives an empty result.
    """
    spark = work.sparkSession
    log = log or generate.log_folder(spark)
    ids = work.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("generation_id").alias("d")).first()
    if ids["n"] != ids["d"]:
        raise ValueError("generation_ids must be different and not null")
    tally = ["__prompt_tokens", "__completion_tokens", "__calls"]
    state = work.withColumn("turns", _none() if opening is None else opening.cast(_TURNS)).withColumns({t: F.lit(0).cast("long") for t in tally}).withColumn("__error", F.lit(None).cast("string"))
    for r, c in enumerate(calls):
        going = F.col("__error").isNull() & (F.coalesce(c.when, F.lit(False)) if c.when is not None else F.lit(True))
        s = state.withColumn("__goes", going)
        s = s.withColumn("turns", F.when(F.col("__goes"), F.concat("turns", F.coalesce(c.before.cast(_TURNS), _none()))).otherwise(F.col("turns"))) if c.before is not None else s
        shown = c.messages.cast(_TURNS) if c.messages is not None else F.col("turns")
        prompt = F.to_json(F.transform(shown, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))
        requests = s.where("__goes").select("generation_id", prompt.alias("prompt"))
        got = generate.call_once(requests, c.client or client, log, r, tries, delay, calls_per_task)
        got = got.select(F.col("generation_id").alias("__id"), F.col("output").alias("answer"), "success", F.col("error").alias("__said_error"), F.col("prompt_tokens").alias("__p"), F.col("completion_tokens").alias("__c"))
        j = s.join(got, F.col("generation_id").cast("string") == F.col("__id"), "left")
        answered = F.col("__goes") & F.coalesce("success", F.lit(False))
        said = F.array(turn(c.role, c.turn_type, F.col("answer") if c.said is None else c.said)).cast(_TURNS)
        added = said if c.after is None else F.concat(said, F.coalesce(c.after.cast(_TURNS), _none()))
        state = j.select(
            *work.columns, F.when(answered, F.concat("turns", added)).otherwise(F.col("turns")).alias("turns"),
            (F.col("__prompt_tokens") + F.coalesce("__p", F.lit(0))).alias("__prompt_tokens"), (F.col("__completion_tokens") + F.coalesce("__c", F.lit(0))).alias("__completion_tokens"), (F.col("__calls") + F.col("__goes").cast("long")).alias("__calls"),
            F.coalesce("__error", F.when(F.col("__goes") & ~answered, F.coalesce("__said_error", F.lit("no answer")))).alias("__error"),
        )
        path = f"{log}/state={r}"
        state.write.mode("overwrite").parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
    output = F.try_element_at(F.filter("turns", lambda t: (t["role"] == "assistant") & (t["turn_type"] == "generation")), F.lit(-1))["content"]
    out = state.withColumn("output", F.coalesce(output, F.lit(""))).withColumn("error", F.coalesce("__error", F.when(texts.blank(F.col("output")), F.lit("empty generation"))))
    return out.select(*work.columns, "turns", "output", F.col("__prompt_tokens").alias("prompt_tokens"), F.col("__completion_tokens").alias("completion_tokens"), F.col("__calls").alias("calls"), F.col("error").isNull().alias("success"), "error")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(generation_id, turn_idx, role, turn_type, content) of what ``run`` returns."""
    return conversations.select("generation_id", F.posexplode("turns").alias("turn_idx", "t")).select("generation_id", "turn_idx", "t.*")


def discovery(questions: int, oracle: Callable[[Column], Column], request: Column, most: Column | None = None) -> list[Call]:
    """Questions, each answered by the oracle, then a generation for ``request``; a row's ``most`` may allow fewer questions."""
    answered = F.array(turn("user", "answer", oracle(F.col("answer"))))
    trimmed = F.trim(F.col("answer"))
    asks = [Call("question", when=None if most is None else most > i, said=trimmed, after=answered) for i in range(questions)]
    return [*asks, Call("generation", before=F.array(turn("user", "generation_prompt", request)))]


def judged_discovery(questions: int, oracle_client: Callable[[], generate.Client], oracle_prompt: Callable[[Column], Column], parse: Callable[[Column], Column], request: Column) -> list[Call]:
    """As ``discovery``, with a model as the oracle: it is shown only ``oracle_prompt`` of the question, and ``parse`` of its reply is the answer."""
    question = F.element_at("turns", -1)["content"]
    shown = F.array(turn("user", "oracle", oracle_prompt(question)))
    asks = [c for _ in range(questions) for c in (Call("question", said=F.trim(F.col("answer"))), Call("answer", "user", oracle_client, said=parse(F.col("answer")), messages=shown))]
    return [*asks, Call("generation", before=F.array(turn("user", "generation_prompt", request)))]


def planning(request: Column) -> list[Call]:
    """A plan, then its execution."""
    return [Call("plan"), Call("generation", before=F.array(turn("user", "execution_prompt", request)))]


def revision(rounds: int, feedback: Callable[[int], Column]) -> list[Call]:
    """A generation and a revision for each round's feedback (a text column, null where there is none); a conversation ends its revisions at the first round without."""
    calls = [Call("generation")]
    for r in range(1, rounds + 1):
        given = F.lit(True)
        for earlier in range(1, r + 1):
            given = given & feedback(earlier).isNotNull()
        calls.append(Call("generation", when=given, before=F.array(turn("user", "feedback", feedback(r)))))
    return calls


def critique(rounds: int, critic: Callable[[], generate.Client], critic_prompt: Callable[[Column], Column], request: Callable[[Column], Column]) -> list[Call]:
    """A generation, and in each round a critique by another model, which sees only ``critic_prompt`` of the current text, and a revision for ``request`` of the critique."""
    latest = F.element_at("turns", -1)["content"]
    shown = F.array(turn("user", "critic", critic_prompt(latest)))
    round_ = [Call("critique", "user", critic, messages=shown), Call("generation", before=F.array(turn("user", "revision_prompt", request(latest))))]
    return [Call("generation"), *round_ * rounds]
