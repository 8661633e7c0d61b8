"""Ranks without one task, reports kept from changes, conversations out of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import aggregates, incremental, ordering, ranking, turns
from quillmark.streaming import conversation_stream, ledger_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_rows(n=400):
    rng = random.Random(n)
    key = lambda: rng.choice([0.0, -0.0, 0.5, 1e-9, -3.0, 1e200, float("inf"), rng.uniform(-5, 5), rng.uniform(0, 1e-5)])
    return [(f"m{i:03d}", key(), rng.choice([None, 1.0, rng.random()])) for i in range(n)]


def test_row_numbers_in_ranges(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "model string, x double, v double").repartition(5)
    ranked = ordering.with_row_number(df, F.col("x"), "model")
    assert {r.model: r["rank"] for r in ranked.collect()} == {m: i + 1 for i, (m, _, _) in enumerate(sorted(rows, key=lambda r: (r[1] + 0.0, r[0])))}
    assert "SinglePartition" not in plan(ranked) and ranked.columns == [*df.columns, "rank"]
    with_null = df.withColumn("x", F.when(F.col("x") != 0.5, F.col("x")))
    assert sorted(r["rank"] for r in ordering.with_row_number(with_null, F.col("x"), "model").collect()) == list(range(1, len(rows) + 1))
    assert ordering.with_row_number(df.limit(0), F.col("x"), "model").count() == 0


def test_running_maxima_in_ranges(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "model string, x double, v double").repartition(5)
    got = ordering.with_running_max(df, F.col("x"), F.col("v"), "model")
    want, best = {}, None
    for m, _, v in sorted(rows, key=lambda r: (r[1] + 0.0, r[0])):
        want[m] = best
        best = max((y for y in (best, v) if y is not None), default=None)
    assert {r.model: r.before_max for r in got.collect()} == want and "SinglePartition" not in plan(got)


def test_slots_never_fall(spark):
    xs = sorted([0.0, 1e-300, -1e-300, 1e308, -1e308, float("inf"), float("-inf"), *[s * 2.0**e * f for s in (1, -1) for e in range(-30, 60) for f in (1, 1.0000001, 1.5)]])
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", ordering.slot(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) > 300


def test_rankings_gather_no_rows_in_one_task(spark):
    df = spark.createDataFrame([(f"c/m{i}", (i * 7 % 10) / 10.0, float(i % 4), i, i) for i in range(30)], "model string, avg_score double, generation_cost double, prompt_tokens long, completion_tokens long").repartition(3)
    for out in (ranking.leaderboard(df), ranking.value_ranking(df), ranking.frontier(df)):
        assert "SinglePartition" not in plan(out)
    ranks = {r.model: r["rank"] for r in ranking.leaderboard(df).collect()}
    assert ranks == {m: i + 1 for i, (_, m) in enumerate(sorted((-(i * 7 % 10) / 10.0, f"c/m{i}") for i in range(30)))}


EVALUATION = "task_id string, task_type string, model string, sample int, evaluator_model string, evaluation_cost double, success boolean, final_score double"


def test_reports_kept_through_upserts_and_purges(spark, tmp_path):
    """Facts that follow the change feed give the reports of a full recomputation, exactly."""
    rng, path = random.Random(3), str(tmp_path / "t")
    keys, measures = incremental.EVALUATION_KEYS, incremental.evaluation_measures()
    row = lambda: (f"t{rng.randrange(4)}_001", "t", f"m{rng.randrange(3)}", rng.randrange(6), f"j{rng.randrange(2)}", rng.uniform(0, 1e-3), rng.choice([True, False, None]), rng.choice([None, rng.random()]))
    order = [F.desc("evaluation_cost")]
    kept = incremental.facts(spark.createDataFrame([], EVALUATION), keys, measures)
    version = -1
    for step in ("upsert", "upsert", "purge", "upsert"):
        if step == "upsert":
            ledger_stream.upsert_batch(spark.createDataFrame([row() for _ in range(60)], EVALUATION), version + 1, path, ("task_id", "model", "sample", "evaluator_model"), order)
        else:
            ledger_stream.delete_where(spark, path, EVALUATION, ~F.coalesce("success", F.lit(True)))
        feed = ledger_stream.changes(spark, path, EVALUATION, ("task_id", "model", "sample", "evaluator_model"), version)
        kept = incremental.updated(kept, feed, keys, measures)
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        version = ledger_stream.current_version(spark, path)
        now = ledger_stream.current(spark, path, EVALUATION)
        for by in (("model",), ("task_type",), ("model", "task_id"), ()):
            a, b = (sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()) for df in (incremental.evaluation_report(kept, *by), aggregates.evaluation_report(now, *by)))
            assert a == b
        assert sorted(map(str, kept.collect())) == sorted(map(str, incremental.facts(now, keys, measures).collect()))
        assert now.where("not success").count() == 0 or step == "upsert"
    assert ledger_stream.delete_where(spark, path, EVALUATION, F.lit(False)) is None


def test_generation_reports_and_status_from_facts(spark):
    from quillmark.sources import adapters

    sf = "/root/testdata/sf0.001"
    g, e = adapters.generations(spark, sf), adapters.evaluations(spark, sf)
    gf = incremental.facts(g, incremental.GENERATION_KEYS, incremental.generation_measures())
    ef = incremental.facts(e, incremental.EVALUATION_KEYS, incremental.evaluation_measures())
    a, b = ({r.model: r for r in df.collect()} for df in (incremental.generation_report(gf, "model"), aggregates.generation_report(g, "model")))
    assert a.keys() == b.keys() and all((a[k].total, a[k].failures, a[k].tokens) == (b[k].total, b[k].failures, b[k].tokens) and a[k].cost == pytest.approx(b[k].cost) for k in a)
    s, t = incremental.status(ef, gf).first(), aggregates.status(e, g).first()
    assert (s.models, s.tasks, s.generations, s.evaluators, s.evaluations) == (t.models, t.tasks, t.generations, t.evaluators, t.evaluations) and s.generation_cost == pytest.approx(t.generation_cost)


STREAMED = "generation_id string, turn_idx int, role string, turn_type string, content string, prompt_tokens long, completion_tokens long, cost double, ts timestamp"


def told(df):
    cut = lambda x: round(x, 9) if isinstance(x, float) else x
    return {r.generation_id: tuple(cut(x) for x in r) for r in df.collect()}


def test_streamed_conversations_equal_stored_ones(spark, tmp_path):
    import datetime

    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for g in range(12):
        for i in range(rng.randrange(1, 14)):
            kind = rng.choice([("assistant", "question"), ("user", "answer"), ("assistant", "generation"), ("system", "system")])
            turn = (f"g{g}", i, *kind, rng.choice(["YES", " yes ", "no", None, "text", "  "]), rng.choice([None, 3, 10]), i, rng.choice([None, 0.25]))
            rows.append((*turn, start + datetime.timedelta(minutes=g * 3, seconds=20 * i)))
            if rng.random() < 0.2:
                rows.append((*turn[:4], "again", 100, 9, 0.5, rows[-1][-1]))
    rng.shuffle(rows)
    source = str(tmp_path / "in")
    for k in range(3):  # shuffled over three batches, all within the watermark
        spark.createDataFrame(rows[k::3], STREAMED).coalesce(1).write.mode("append").parquet(source)
    end = ("zz", 0, "system", "system", "tick", None, None, None, start + datetime.timedelta(hours=9))
    stream = spark.readStream.schema(STREAMED).option("maxFilesPerTrigger", 1).parquet(source)

    def go():
        out = conversation_stream.closed(stream, "30 minutes", "2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    go()
    assert spark.read.schema(f"generation_id string, turns {conversation_stream.TURNS}").parquet(str(tmp_path / "out")).count() == 0  # none has closed yet
    for n in range(2):
        spark.createDataFrame([end[:-1] + (end[-1] + datetime.timedelta(hours=n),)], STREAMED).coalesce(1).write.mode("append").parquet(source)
    go()
    closed = spark.read.parquet(str(tmp_path / "out"))
    stored = spark.createDataFrame(rows, STREAMED)
    assert told(conversation_stream.summaries(closed)) == told(conversation_stream.summaries(conversation_stream.gathered(stored)))
    assert closed.count() == 12


def test_summaries_equal_the_relational_operators(spark):
    from quillmark.sources import adapters

    t = adapters.turns(spark, "/root/testdata/sf0.001").withColumns({"prompt_tokens": F.col("turn_idx") + 1, "completion_tokens": F.length("content"), "cost": F.lit(0.5)})
    s = {r.generation_id: r for r in conversation_stream.summaries(conversation_stream.gathered(t)).collect()}
    for r in turns.turn_metrics(t).collect():
        assert (r.total_turns, r.questions_asked, r.constraints_discovered, r.revision_count) == (s[r.generation_id].total_turns, s[r.generation_id].questions_asked, s[r.generation_id].constraints_discovered, s[r.generation_id].revision_count)
    assert {r.generation_id: (r.prompt_tokens, r.completion_tokens, r.cost) for r in turns.token_rollup(t).collect()} == {k: (r.prompt_tokens, r.completion_tokens, r.cost) for k, r in s.items()}
    asked = sorted((r.generation_id, r.turn_idx, r.question, r.answer) for r in turns.question_answers(t).collect())
    assert asked == sorted((k, q.turn_idx, q.question, q.answer) for k, r in s.items() for q in r.questions)
    assert {r.generation_id: (r.output, r.blank) for r in turns.last_generation(t).collect()} == {k: (r.output, r.blank) for k, r in s.items() if r.output is not None}
