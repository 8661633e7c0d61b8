"""Conversation analytics: answers, final outputs, plans, revisions, oracle answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as texts

CONVERSATION = ("generation_id",)


def question_answers(turns: DataFrame) -> DataFrame:
    """Each question with the turn after it; "N/A" at the end of a conversation."""
    after = F.lead("content").over(Window.partitionBy(*CONVERSATION).orderBy("turn_idx"))
    return turns.withColumn("answer", F.coalesce(after, F.lit("N/A"))).where("turn_type = 'question'").select("generation_id", "turn_idx", F.col("content").alias("question"), "answer")


def turn_metrics(turns: DataFrame) -> DataFrame:
    """Counts by conversation: turns, questions, YES answers, revisions."""
    kind = F.col("turn_type")
    return turns.groupBy("generation_id").agg(
        F.count(F.lit(1)).alias("total_turns"), F.count_if(kind == "question").alias("questions_asked"), F.count_if((kind == "answer") & (F.upper(F.trim("content")) == "YES")).alias("constraints_discovered"),
        F.greatest(F.count_if(kind == "generation") - 1, F.lit(0)).alias("revision_count"),
    )


def last_generation(turns: DataFrame) -> DataFrame:
    """The last assistant generation, untrimmed, and whether it is blank."""
    last = F.max_by("content", "turn_idx")
    g = turns.where("role = 'assistant' and turn_type = 'generation'").groupBy("generation_id").agg(last.alias("output"), F.max("turn_idx").alias("turn_idx"))
    return g.withColumn("blank", texts.blank(F.col("output")))


def clipped(text: Column, most: int = 2000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def first_plan(turns: DataFrame, kind: str = "plan", most: int = 2000) -> DataFrame:
    """The first turn of a kind, clipped."""
    g = turns.where(F.col("turn_type") == kind).groupBy("generation_id").agg(F.min_by("content", "turn_idx").alias("plan"))
    return g.withColumn("plan", clipped(F.col("plan"), most))


def trajectory(turns: DataFrame, kind: str = "generation", most: int | None = None, width: int = 500) -> DataFrame:
    """(generation_id, revision, excerpt): the first characters of each turn of a kind, the first ``most`` of them if given."""
    n = F.row_number().over(Window.partitionBy(*CONVERSATION).orderBy("turn_idx"))
    t = turns.where(F.col("turn_type") == kind).select("generation_id", n.alias("revision"), F.left("content", F.lit(width)).alias("excerpt"))
    return t if most is None else t.where(F.col("revision") <= most)


def token_rollup(turn_facts: DataFrame) -> DataFrame:
    """Tokens and cost by conversation, from per-turn facts."""
    return turn_facts.groupBy("generation_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"))


def keyword_answer(question: Column, constraints: Column) -> Column:
    """Answer of the first constraint (array<struct<patterns, answer>>) with a pattern inside the question; else "NO"."""
    low = F.lower(question)
    hit = F.filter(constraints, lambda c: F.exists(c["patterns"], lambda p: F.contains(low, F.lower(p))))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["answer"], F.lit("NO"))


def oracle_answer(reply: Column, answers: Column) -> Column:
    """An oracle's reply as an answer: NONE means NO; digits name a constraint (from 1); else YES if it says so or is all digits."""
    up = F.upper(F.trim(reply))
    digits = F.regexp_replace(up, "[^0-9]", "")
    at = digits.try_cast("int")
    named = F.when((at >= 1) & (at <= F.size(answers)), F.coalesce(F.try_element_at(answers, at), F.lit("NO")))
    yes = F.contains(up, F.lit("YES")) | (up.rlike("^[0-9]+$"))
    return F.when(up.startswith("NONE"), "NO").otherwise(F.coalesce(named, F.when(yes, "YES").otherwise("NO")))


def feedback(rules: DataFrame, rounds: DataFrame) -> DataFrame:
    """Feedback of each round: rules (task_id, round, focus, items) joined on the round; rounds after the first missing one get none."""
    seen = Window.partitionBy("generation_id").orderBy("round")
    j = rounds.join(rules, ["task_id", "round"], "left").withColumn("__gap", F.max(F.col("focus").isNull()).over(seen))
    return j.where("not __gap").drop("__gap")
