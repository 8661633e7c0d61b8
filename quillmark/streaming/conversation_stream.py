"""Conversations out of a stream of turns: each is emitted once, when it closes.

A conversation's turns are kept as keyed state until the event time has
passed its last turn by an idle time. Turns may come shuffled, repeated and late, as
long as the watermark lets them in. What is emitted is the conversation as an
array of turns in order, and the same column expressions that summarise a
stored conversation summarise it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as texts

TURNS = "array<struct<turn_idx:int,role:string,turn_type:string,content:string,prompt_tokens:bigint,completion_tokens:bigint,cost:double>>"
_FIELDS = {"turn_idx": "int", "role": "string", "turn_type": "string", "content": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint", "cost": "double"}
_VALUE = {"int": int, "bigint": int, "double": float, "string": str}


def _turn() -> Column:
    return F.struct(*[F.col(c).cast(t).alias(c) for c, t in _FIELDS.items()])


def gathered(turns: DataFrame) -> DataFrame:
    """(generation_id, turns): stored conversations as arrays in order; of turns with one turn_idx the greatest stays, those without one are left out."""
    t = turns.where("turn_idx is not null").groupBy("generation_id", F.col("turn_idx").alias("__i")).agg(F.max(_turn()).alias("t"))
    return t.groupBy("generation_id").agg(F.array_sort(F.collect_list("t")).cast(TURNS).alias("turns"))


def closed(turns: DataFrame, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(generation_id, turns) of a stream of turns (generation_id string, ts timestamp, and the fields of a turn), when ``idle`` event time has passed since the last one.

    Turns later than ``late`` behind the newest event are dropped by the watermark. Of turns with one turn_idx the greatest stays. A turn that
    arrives after its conversation has closed opens another one of the same id.
    """
    kinds = [_VALUE[t] for t in _FIELDS.values()]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else ("[]", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"generation_id": [key[0]], "turns": [held]})
            return
        known = {int(t[0]): t for t in json.loads(held)}
        order = lambda t: [(x is not None, x if x is None else kind(x)) for x, kind in zip(t, kinds)]  # noqa: E731  null is the least, as in Spark
        for pdf in batches:
            for t, at in zip(pdf["t"], pdf["at"]):
                t, last = json.loads(t), max(last, int(at))
                known[int(t[0])] = max(known.get(int(t[0]), t), t, key=order)
        state.update((json.dumps([known[k] for k in sorted(known)]), last))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    packed = F.to_json(F.array(*[F.col(c).cast("string") for c in _FIELDS]))
    slim = turns.withWatermark("ts", late).where("turn_idx is not null").select("generation_id", "ts", F.unix_millis("ts").alias("at"), packed.alias("t"))
    out = slim.groupBy("generation_id").applyInPandasWithState(run, "generation_id string, turns string", "turns string, last long", "append", GroupStateTimeout.EventTimeTimeout)
    rows = F.from_json("turns", "array<array<string>>")
    return out.select("generation_id", F.transform(rows, lambda t: F.struct(*[t[i].cast(k).alias(c) for i, (c, k) in enumerate(_FIELDS.items())])).cast(TURNS).alias("turns"))


def summaries(conversations: DataFrame) -> DataFrame:
    """What is told of each conversation (generation_id, turns), stored or just closed: counts, tokens and cost, questions with their answers, and the last generation.

    Equal to ``turns.turn_metrics``, ``token_rollup``, ``question_answers`` and ``last_generation`` of its turns.
    """
    of = lambda kind: F.size(F.filter("turns", lambda t: F.coalesce(t["turn_type"] == kind, F.lit(False))))
    yes = F.size(F.filter("turns", lambda t: F.coalesce((t["turn_type"] == "answer") & (F.upper(F.trim(t["content"])) == "YES"), F.lit(False))))
    total = lambda c, zero: F.aggregate("turns", F.lit(None).cast(zero), lambda a, t: F.coalesce(a + t[c], t[c], a))
    numbered = F.transform("turns", lambda t, i: F.struct(t["turn_idx"].alias("turn_idx"), t["turn_type"].alias("kind"), t["content"].alias("question"), F.coalesce(F.get("turns", i + 1)["content"], F.lit("N/A")).alias("answer")))
    asked = F.transform(F.filter(numbered, lambda q: F.coalesce(q["kind"] == "question", F.lit(False))), lambda q: F.struct(q["turn_idx"], q["question"], q["answer"]))
    written = F.filter("turns", lambda t: F.coalesce((t["role"] == "assistant") & (t["turn_type"] == "generation"), F.lit(False)))
    s = conversations.select(
        "generation_id", F.size("turns").alias("total_turns"), of("question").alias("questions_asked"), yes.alias("constraints_discovered"), F.greatest(of("generation") - 1, F.lit(0)).alias("revision_count"),
        total("prompt_tokens", "bigint").alias("prompt_tokens"), total("completion_tokens", "bigint").alias("completion_tokens"), total("cost", "double").alias("cost"),
        asked.alias("questions"), F.try_element_at(written, F.lit(-1))["content"].alias("output"),
    )
    return s.withColumn("blank", texts.blank(F.col("output")))
