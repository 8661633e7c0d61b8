"""Operators on hand-made edge rows."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import judge, names, rules, text
from quillmark.operators import aggregates, generate, ledger, ranking, report, stats, turns
from quillmark.sources import ingest
from quillmark.streaming import ledger_stream


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first()


def test_fixed_values():
    assert (len(K.STOP_WORDS), len(set(K.STOP_WORDS)), len(K.OVERUSED_2), len(K.OVERUSED_1), len(K.OVERUSED_PHRASES)) == (105, 105, 41, 41, 14)
    assert all(abs(sum(w for w, _ in v.values()) - 1) < 1e-9 for v in K.JUDGE_WEIGHTS.values())


@pytest.mark.parametrize("words, gaussian, tanh, sigmoid", [(500, 1, 1, 1), (350, 0.952345, 0.238406, 0.364851), (200, 0.457833, 0.000671, 0.004945), (650, 0.952345, 0.238406, 0.364851), (900, 0.172422, 0.000012, 0.000247), (400, 1, 1, 1), (600, 1, 1, 1)])
def test_word_count_scores(spark, words, gaussian, tanh, sigmoid):
    got = one(spark, *[text.word_count_score(F.lit(words), F.lit(400), F.lit(600), m) for m in ("gaussian", "tanh", "sigmoid")])
    assert got == pytest.approx((gaussian, tanh, sigmoid), abs=1e-6)


def test_word_count_limits(spark):
    assert one(spark, text.word_count_score(F.lit(250_000), F.lit(400), F.lit(600), "sigmoid"))[0] == 0
    assert one(spark, text.word_count_score(F.lit(450), F.lit(500), F.lit(500)))[0] == pytest.approx(math.exp(-0.5))
    with pytest.raises(ValueError):
        text.word_count_score(F.lit(1), F.lit(1), F.lit(1), "other")


def tokenize(t):
    return re.findall(r"\b[a-zA-Z]+\b", (t or "").lower())


def brute_repetition(t):
    words = tokenize(t)
    content = [w for w in words if w not in K.STOP_WORDS and len(w) > 2]
    if len(words) < 20 or len(content) < 10:
        return 0.7
    n = Counter(content)
    limit = max(3, 2 * len(content) / len(n))
    penalty = sum((c - limit) * 0.02 for c in n.values() if c > limit) + sum((c - 3) * 0.03 for c in Counter(zip(words, words[1:])).values() if c > 3)
    return max(0.0, 1 - min(0.5, penalty))


def brute_slop(t):
    words = tokenize(t)
    if len(words) < 20:
        return 0.8
    penalty = sum(K.OVERUSED_WORDS.get(w, 0) for w in words) + sum(t.lower().count(p) * v for p, v in K.OVERUSED_PHRASES.items())
    return max(0.0, 1 - penalty / len(words) * 100 * 0.05)


EDGE_TEXTS = [
    None, "", " \n", "word " * 19, "word " * 20, "the of and " * 10 + "alpha beta gamma delta epsilon zeta eta theta iota", "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3,
    "naïve über_x a1b2 straße " * 9, "We delve into the rich tapestry of a realm; it's worth noting that " * 4, "it’s worth noting " * 12, "one two three four " * 5, "DELVE Into Delve into " * 30,
    "one\xa0two\u3000three\x1cfour\x85five " * 5, "\u3000\xa0\x1f", "ab\u2003cd " * 9,
    "alpha beta " * 40 + " ".join(f"w{chr(97 + i)}x" for i in range(26)), "aaa bbb ccc ddd eee fff ggg hhh iii jjj kkk lll mmm nnn ooo ppp qqq rrr sss ttt aaa aaa aaa aaa aaa",
]


def test_text_scores_equal_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(EDGE_TEXTS)), "doc_id int, text string")
    rep = {r.doc_id: r.repetition_score for r in text.repetition_scores(df).collect()}
    rest = {r.doc_id: r for r in df.select("doc_id", text.slop_score(F.col("text")).alias("slop"), text.tokens(F.col("text")).alias("t"), text.word_count(F.col("text")).alias("n")).collect()}
    for i, t in enumerate(EDGE_TEXTS):
        assert rep[i] == pytest.approx(brute_repetition(t)), t
        assert rest[i].slop == pytest.approx(brute_slop(t or "")), t
        assert rest[i].t == tokenize(t) and rest[i].n == len((t or "").split())


def test_sentences_and_budgets(spark):
    assert one(spark, text.sentences(F.lit("One.  Two!? \n Three")))[0] == ["One", "Two", "Three"]
    assert one(spark, text.sentences(F.lit("\xa0One\u3000.\u2003!\x1c?\x85Two")))[0] == ["One", "Two"]
    assert tuple(one(spark, *text.beat_budget(F.lit(600), F.lit(905), F.lit(4)))) == (150, 226)
    assert tuple(one(spark, *text.word_range(F.lit("theory_conversion")))) == (500, 800)
    assert tuple(one(spark, *text.word_range(F.lit("x"), F.lit(None).cast("int"), F.lit(9)))) == (300, 9)
    with pytest.raises(ValueError):
        text.final_score(F.lit(1.0), F.lit(1.0), (0.5, 0.6))


def test_judge_scores(spark):
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    got = one(
        spark,
        judge.judge_score("beat_revision", m(correct_diagnosis_score="1", reasoning_quality_score="true")),
        judge.judge_score("beat_revision", m(diagnosis_score="1.5", junk_score="9")),
        judge.judge_score("beat_interpolation", F.create_map().cast("map<string,string>")),
        judge.judge_score_by_type(F.lit("theory_conversion"), m(beats_score="1", tone_score="8/10")),
        judge.agentic_scores("planning_execution", m(plan_adherence="1", narrative_quality="0"))[2],
        judge.agentic_scores("other", m(a="1"))[2],
    )
    assert tuple(got) == pytest.approx((0.40 + 0.15 * 0.5 + 0.15, 0.2 * 1.5 + 0.7 * 0.5 + 0.1, 0, 0.35 + 0.325, 0.35 * 2 / 3 + 0.65 / 3, 0))
    with pytest.raises(ValueError):
        judge.judge_score("other", F.lit(None))


def test_json_extraction(spark):
    texts = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'it is {"a": 3} really', "none", None, "", "```\n[1]\n```"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", judge.extract_json(F.col("t")).alias("j"))
    assert [r.j for r in df.orderBy("i").collect()] == ['{"a": 1}', '{"a": 2}', '{"a": 3}', None, None, None, "[1]"]


def test_names(spark):
    f = lambda x: F.lit(x)
    got = one(spark, names.company_name(f("z-ai/x")), names.company_name(f("acme-labs/x")), names.company_name(f("solo")), names.short_name(f("a/b/c")), names.display_name(f("q/gpt-4-gpt-x")), names.task_type_of(f("a_b_001")), names.task_type_of(f("plain")), names.is_agentic(f("critique_improvement")), names.file_stem(f("t"), f("a/b"), f(0)), names.token_cost(f(1_000_000), f(2_000_000), f(0.5), f(1.0)))
    assert tuple(got) == ("Z-Ai", "Acme-Labs", "Unknown", "c", "GPT-4-GPT-x", "a_b", "plain", True, "t_a_b_0", 2.5)


def test_pass_rules(spark):
    r = F.struct(F.lit(True).alias("a"), F.lit(None).cast("boolean").alias("b"), F.lit(True).alias("c"), F.lit(True).alias("d"), F.lit(True).alias("e"))
    none = F.create_map().cast("map<string,boolean>")
    nested = F.create_map().cast("map<string,map<string,boolean>>")
    got = one(spark, rules.interpolation_pass(r, ("a", "c")), rules.interpolation_pass(r, ("a", "b")), rules.revision_pass(r, ("a",), ("c", "d", "e")), rules.continuation_pass(none), rules.conversion_pass(F.lit(True), F.lit(True), F.lit(0.7)), rules.conversion_pass(F.lit(True), F.lit(None), F.lit(1.0)), rules.synthesis_pass(none, nested, F.lit(True)))
    assert tuple(got) == (True, False, True, False, True, False, True)


def test_aggregates_on_edge_cells(spark):
    rows = [("t", "x", "a/m", 0, "j1", 0.1, True, 0.2), ("t", "x", "a/m", 0, "j2", 0.1, None, 0.6), ("t", "x", "a/m", 0, "j3", 0.1, False, 0.9), ("t", "x", "b", 0, "j1", 0.1, True, None), ("t", "x", "b", 0, "j2", 0.1, True, 0.4), ("u", "x", "b", 0, "j1", 0.1, True, 0.5)]
    e = spark.createDataFrame(rows, "task_id string, task_type string, model string, sample int, evaluator_model string, evaluation_cost double, success boolean, final_score double")
    cells = aggregates.cell_scores(e)
    assert {(r.model, r.task_id): (r.score, r.evaluations) for r in cells.collect()} == {("a/m", "t"): (pytest.approx(0.4), 2), ("b", "t"): (0.4, 1), ("b", "u"): (0.5, 1)}
    g = spark.createDataFrame([("t", "a/m", 0, 0.0, 10, 5, 8, True), ("t", "b", 0, 2.0, 10, 10, 0, None), ("t", "b", 1, 5.0, 1, 1, 0, False)], "task_id string, model string, sample int, generation_cost double, prompt_tokens long, completion_tokens long, reasoning_tokens long, success boolean")
    tasks = spark.createDataFrame([("t", "dim", "th")], "task_id string, task_type string, theory string")
    st = {r.task_id: r for r in aggregates.task_stats(cells, tasks, g).collect()}
    assert (st["t"].best_model, st["t"].worst_model, st["t"].task_type, st["u"].task_type, st["u"].stdev, st["u"].theory) == ("a/m", "a/m", "dim", "x", 0.0, "Unknown")
    eff = {r.model: r for r in aggregates.cost_efficiency(aggregates.model_costs(g)).collect()}
    assert (eff["a/m"].output_tokens, eff["a/m"].cost_per_1k_output, eff["b"].reasoning_pct) == (-3, 0.0, 0.0)
    assert [r.model for r in ranking.value_ranking(aggregates.summary(e, g)).collect()] == ["b"]
    assert report.markdown_table(aggregates.model_scores(cells).orderBy("model"), {"avg_score": report.percent}).splitlines()[2] == "| a/m | 40.0% | 1 |"


def test_frontier_and_markers(spark):
    p = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.5), ("c", 3.0, 0.9), ("d", 1.0, 0.6)], "model string, generation_cost double, avg_score double")
    assert {r.model for r in ranking.frontier(p).where("on_frontier").collect()} == {"d", "c"}
    assert {r.marker for r in ranking.marker_sizes(p.withColumn("total_tokens", F.lit(3))).collect()} == {100.0}


def test_ledger_is_idempotent(spark):
    schema = "task_id string, model string, sample int, success boolean, v int"
    now = spark.createDataFrame([("t", "m", 0, True, 1), ("t", "n", 0, False, 2)], schema)
    batch = spark.createDataFrame([("t", "m", 0, True, 5), ("t", "m", 0, True, 6), ("u", "m", 0, None, 7)], schema)
    last = ledger.latest(batch, ledger.GENERATION_KEY, F.desc("v"))
    once = ledger.upsert(now, last, ledger.GENERATION_KEY)
    twice = ledger.upsert(once, last, ledger.GENERATION_KEY)
    want = [("t", "m", 6), ("t", "n", 2), ("u", "m", 7)]
    assert sorted((r.task_id, r.model, r.v) for r in once.collect()) == sorted((r.task_id, r.model, r.v) for r in twice.collect()) == want
    assert ledger.purge_failed(once).count() == 2 and ledger.purge_failed(once, "zz").count() == 3
    tasks, models = (spark.createDataFrame([(x,) for x in v], f"{c} string") for c, v in (("task_id", "tu"), ("model", "mn")))
    assert sorted(tuple(r) for r in ledger.missing_generations(tasks, models, once).collect()) == [("t", "n"), ("u", "n")]
    assert ledger.find(once, task_id="t", model="m").first().v == 6


def test_p_values(spark):
    df = spark.createDataFrame([(2.228, 10), (0.0, 5), (2.0, 60), (-2.0, 60), (None, 3), (12.706, 1)], "t double, df long")
    got = [r.p for r in stats.with_p_values(df.coalesce(1)).collect()]
    assert got[4] is None and [p for p in got if p is not None] == pytest.approx([0.05001, 1.0, 0.050033, 0.050033, 0.05], abs=1e-5)


def test_p_values_to_nine_digits_without_python(spark):
    """Against the t distribution of the mathematics library that Spark itself ships."""
    cases = [(t, df) for df in (1, 2, 3, 4, 7, 30, 66, 500, 12_345) for t in (0.0, 0.01, 0.3, -1.0, 1.96, 2.5, -8.0, 40.0)]
    got = stats.with_p_values(spark.createDataFrame(cases, "t double, df long"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    known = spark.sparkContext._jvm.org.apache.commons.math3.distribution.TDistribution
    for r in got.collect():
        assert r.p == pytest.approx(2 * known(float(r.df)).cumulativeProbability(-abs(r.t)), rel=1e-9, abs=1e-14), (r.t, r.df)
    n = 1_000_000  # where that library loses digits itself: the normal distribution and the first term of the difference
    for r in stats.with_p_values(spark.createDataFrame([(t, n) for t in (0.0, 0.01, 0.5, -1.0, 2.5)], "t double, df long")).collect():
        t = abs(r.t)
        assert r.p == pytest.approx(math.erfc(t / math.sqrt(2)) + 2 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t**3 + t) / (4 * n), rel=1e-9)
    (tiny,) = stats.with_p_values(spark.createDataFrame([(1e-6, 66)], "t double, df long")).collect()
    assert 1 - tiny.p == pytest.approx(2e-6 * math.exp(math.lgamma(33.5) - math.lgamma(33)) / math.sqrt(66 * math.pi), rel=1e-6)  # twice the density at 0
    values = [1e-3, 0.5, 1.0, 1.5, 3.25, 20.0, 1e4, 5e5]
    gammas = one(spark, *[stats.log_gamma(F.lit(v)) for v in values])
    assert list(gammas) == pytest.approx([math.lgamma(v) for v in values], rel=1e-13, abs=1e-13)
    betas = one(spark, *[stats.log_beta(F.lit(v), F.lit(0.5)) for v in values])
    assert list(betas) == pytest.approx([math.lgamma(v) + math.lgamma(0.5) - math.lgamma(v + 0.5) for v in values], rel=1e-9)


def test_pairs_without_variance(spark):
    rows = spark.createDataFrame([(m, 0.5) for m in "aabb"] + [("c", 0.1)], "model string, score double")
    (r,) = stats.with_p_values(stats.pairwise(rows)).collect()
    assert (r.model_a, r.model_b, r.t, r.p, r.cohens_d, r.significant) == ("a", "b", None, None, 0.0, False)


def test_turns(spark):
    rows = [("g", 0, "system", "system", "s"), ("g", 1, "assistant", "question", "Q1"), ("g", 2, "user", "answer", " yes "), ("g", 3, "assistant", "generation", "draft"), ("g", 4, "assistant", "generation", "  "), ("g", 5, "assistant", "question", "Q2"), ("h", 0, "assistant", "plan", "p" * 2100)]
    t = spark.createDataFrame(rows, "generation_id string, turn_idx int, role string, turn_type string, content string")
    assert [(r.question, r.answer) for r in turns.question_answers(t).orderBy("turn_idx").collect()] == [("Q1", " yes "), ("Q2", "N/A")]
    m = turns.turn_metrics(t).where("generation_id = 'g'").first()
    assert (m.total_turns, m.questions_asked, m.constraints_discovered, m.revision_count) == (6, 2, 1, 1)
    assert (turns.last_generation(t).first().output, turns.last_generation(t).first().blank) == ("  ", True)
    assert len(turns.first_plan(t).first().plan) == 2003 and turns.trajectory(t, most=1).count() == 1
    rules_ = spark.createDataFrame([("k", 1, "f", ["i"]), ("k", 3, "f", ["i"])], "task_id string, round int, focus string, items array<string>")
    rounds = spark.createDataFrame([("g", "k", i) for i in (1, 2, 3)], "generation_id string, task_id string, round int")
    assert [r["round"] for r in turns.feedback(rules_, rounds).collect()] == [1]


def test_ingest(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"task_id": "t_001", "model": "c/m", "output": "x", "metadata": {"cost": 0.5, "success": false}}')
    (tmp_path / "b.yaml").write_text("task_id: t_002\nmodel: c/m\nsample_index: 2\nmetadata:\n  prompt_tokens: 7\n") if _yaml() else (tmp_path / "b.yaml").write_text('{"task_id": "t_002", "model": "c/m", "sample_index": 2, "metadata": {"prompt_tokens": 7}}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"task_id": "t_003"}')
    docs = ingest.documents(spark, str(tmp_path))
    assert ingest.corrupt(docs).count() == 1
    g = {r.task_id: r for r in ingest.standard_generations(docs).collect()}
    assert set(g) == {"t_001", "t_002"} and (g["t_001"].success, g["t_001"].generation_cost, g["t_002"].success, g["t_002"].sample, g["t_002"].prompt_tokens) == (False, 0.5, True, 2, 7)
    assert ingest.load_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def _yaml():
    try:
        import yaml  # noqa: F401
    except ImportError:
        return False
    return True


def test_streaming_upserts(spark, tmp_path):
    schema = "k string, v int, ts timestamp, event_type string, success boolean"
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for rows in ([("a", 1), ("b", 2), ("a", 3)], [("b", 5)]):
        df = spark.createDataFrame(rows, "k string, v int").selectExpr("k", "v", "timestamp'2024-01-01 00:10:00' as ts", "'x' as event_type", "v > 1 as success")
        df.coalesce(1).write.mode("append").parquet(source)
        ledger_stream.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ("k",), [F.desc("v")]).awaitTermination()
    assert {r.k: r.v for r in ledger_stream.current(spark, str(tmp_path / "out"), schema).collect()} == {"a": 3, "b": 5}
    version = ledger_stream.current_version(spark, str(tmp_path / "out"))
    ledger_stream.upsert_batch(spark.read.schema(schema).parquet(source), version, str(tmp_path / "out"), ("k",), [F.desc("v")], str(tmp_path / "cp"))
    assert ledger_stream.current_version(spark, str(tmp_path / "out")) == version
    (r,) = ledger_stream.error_rates(spark.read.schema(schema).parquet(source)).collect()
    assert (r.n, r.failed) == (4, 1)


def test_model_calls(spark):
    work = spark.createDataFrame([("g1", "a b"), ("g2", "fail now"), ("g3", None)], "generation_id string, prompt string")
    got = {r.generation_id: r for r in generate.call_model(work, generate.stub_client, tries=2, delay=0.0).collect()}
    assert (got["g1"].output, got["g1"].success, got["g1"].attempts) == ("b a", True, 1)
    assert (got["g2"].success, got["g2"].attempts, got["g3"].error) == (False, 2, "no prompt") and "asked to fail" in got["g2"].error
    talk = generate.conversation(work, generate.stub_client, 2, lambda answer, r: F.concat(answer, F.lit(" more")), 1, 0.0)
    assert [(r.turn_idx, r.role, r.content) for r in talk.where("generation_id = 'g1'").orderBy("turn_idx").collect()] == [(0, "user", "a b"), (1, "assistant", "b a"), (2, "user", "b a more"), (3, "assistant", "more a b")]
    assert talk.where("generation_id = 'g2'").count() == 2


def test_every_generation_has_a_file_name(spark):
    from quillmark.plans import catalog
    from quillmark.sources import adapters

    sf = "/root/testdata/sf0.001"
    want = sorted((r.sample, f"{r.task_id}_{r.model.replace('/', '_')}_{r.sample}") for r in adapters.generations(spark, sf).collect())
    assert sorted(map(tuple, catalog.queries()["file_names"](spark, sf).collect())) == want and want[-1][0] >= 500


def test_registered_slop_scores_look_for_the_whole_lists(spark, tmp_path):
    from quillmark.plans import catalog

    filler = " ".join(f"plain{i}" for i in range(30))
    listed = [*K.OVERUSED_WORDS, *K.OVERUSED_PHRASES]
    docs = [(i, f"{filler} {w} {filler}") for i, w in enumerate(listed)] + [(len(listed), f"{filler} the of and la der de"), (len(listed) + 1, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    slop, whole = ({r[0]: r[1] for r in catalog.queries()[q](spark, str(tmp_path)).collect()} for q in ("slop_score", "programmatic_score"))
    assert slop == {i: pytest.approx(brute_slop(t), abs=1e-6) for i, t in docs} and all(slop[i] < 1 for i in range(len(listed)))
    words = {i: len(t.split()) for i, t in docs}
    fits = {r[0]: r[1] for r in spark.createDataFrame(list(words.items()), "i long, n int").select("i", text.word_count_score(F.col("n"), F.lit(300), F.lit(500))).collect()}
    assert whole == {i: pytest.approx(0.4 * fits[i] + 0.35 * brute_repetition(t) + 0.25 * brute_slop(t), abs=2e-6) for i, t in docs}


def test_repetition_scores_rows_not_ids(spark):
    different, same = " ".join(chr(97 + i) * 4 for i in range(20)), "alpha beta gamma " * 20
    df = spark.createDataFrame([(1, different), (1, same), (None, same)], "doc_id int, text string")
    assert sorted(r.repetition_score for r in text.repetition_scores(df).collect()) == pytest.approx(sorted(map(brute_repetition, (different, same, same))))


def test_safe_float_takes_what_python_takes(spark):
    def plain(x):
        try:
            return float(x)
        except ValueError:
            return 0.25

    values = ["1d", "0.8f", "1", " 0.5 ", ".5", "5.", "1e3", "1_000.5", "_1", "1__0", "0x10", "1,5", "", "+7", "-.5e-1", "8/10", "1e", "inf", "-Infinity", "true ly"]
    got = one(spark, *[judge.safe_float(F.lit(v), 0.25) for v in values])
    assert list(got) == [plain(v) for v in values]
    assert tuple(one(spark, judge.safe_float(F.lit("True")), judge.safe_float(F.lit(None).cast("string"), 0.5))) == (1.0, 0.5)


def test_extreme_types_of_three(spark):
    rates = spark.createDataFrame([("task_type", t, r) for t, r in (("a", 0.1), ("b", 0.5), ("c", 0.9))], "scope string, task_type string, rate double")
    assert sorted((r.task_type, r.end) for r in ranking.extreme_types(rates).collect()) == [("a", "weakest"), ("b", "strongest"), ("b", "weakest"), ("c", "strongest")]


def test_synthesis_needs_its_cross_checks(spark):
    cross = lambda v: F.create_map(F.lit("m"), F.lit(v))
    none, nested = F.lit(None).cast("map<string,map<string,boolean>>"), F.create_map(F.lit("x"), F.create_map(F.lit("p"), F.lit(True)))
    got = one(spark, *[rules.synthesis_pass(c, r, F.lit(o)) for c, r, o in ((cross(False), none, True), (cross(True), none, True), (cross(True), none, False), (cross(False), nested, True), (cross(True), nested, False))])
    assert tuple(got) == (False, True, False, False, True)


def test_names_in_leaderboard_and_charts(spark):
    odd = ["ai21labs", "x_y", "a.b", "z-ai", "o'neil-2go", "ÉCOLE9b"]
    assert list(one(spark, *[names.company_name(F.lit(f"{x}/m")) for x in odd])) == [x.title() for x in odd]
    m = [F.lit(x) for x in ("z-ai/x", "moonshotai/x", "x-ai/x")]
    assert tuple(one(spark, *map(names.company_name, m))) == ("Z-Ai", "Moonshotai", "xAI")
    assert tuple(one(spark, *[names.company_name(x, K.CHART_COMPANY_NAMES) for x in m])) == ("Z-AI", "Moonshot", "xAI")


def test_new_stream_on_an_old_ledger_loses_nothing(spark, tmp_path):
    schema, out = "k string, v int", str(tmp_path / "out")
    for source, rows in (("one", [("a", 1)]), ("one", [("b", 2)]), ("two", [("a", 7), ("c", 3)]), ("two", [("d", 4)])):
        number = {("one", "a"): 0, ("one", "b"): 1, ("two", "a"): 0, ("two", "d"): 1}[source, rows[0][0]]
        for _ in range(2):  # a batch that runs again changes nothing
            ledger_stream.upsert_batch(spark.createDataFrame(rows, schema), number, out, ("k",), [F.desc("v")], source)
    assert {r.k: r.v for r in ledger_stream.current(spark, out, schema).collect()} == {"a": 7, "b": 2, "c": 3, "d": 4}
    assert ledger_stream.current_version(spark, out) == 3
    ledger_stream.upsert_batch(spark.createDataFrame([], schema), 2, out, ("k",), [F.desc("v")], "two")
    ledger_stream.upsert_batch(spark.createDataFrame([("a", 1)], schema), 3, out, ("k",), [F.desc("v")], "two")
    assert {r.k: r.v for r in ledger_stream.current(spark, out, schema).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}


def _result_files(folder):
    import json

    for d in ("generations", "evaluations", "agentic"):
        (folder / d).mkdir(parents=True)
    put = lambda name, x: (folder / name).write_text(x if isinstance(x, str) else json.dumps(x))
    put("generations/a.yaml", {"task_id": "beat_revision_001", "task_type": "beat_revision", "model": "c/m", "output": "x", "metadata": {"cost": 0.5, "prompt_tokens": 3}})
    put("generations/b.yaml", "{broken")
    put("agentic/gen_a.yaml", {"generation_id": "g1", "task_id": "agentic_planning_execution_001", "model": "c/m", "token_usage": {"total_cost": 0.25, "total_completion_tokens": 9}, "metrics": {"total_turns": 2}, "agentic_type": "planning_execution", "turns": [{"role": "user", "content": "hi", "turn_type": "plan_prompt"}, {"role": "assistant", "content": "plan", "turn_type": "plan"}]})
    put("agentic/eval_a.yaml", {"task_id": "agentic_planning_execution_001", "model": "c/m", "evaluator_model": "j", "final_score": 0.5, "process_scores": {"p": 0.25}, "output_scores": {"o": 0.75}, "evaluator_cost": 0.1})
    put("evaluations/a.yaml", {"task_id": "beat_revision_001", "model": "c/m", "evaluator_model": "j", "final_score": 0.75, "score_breakdown": {"components": {"programmatic": {"score": 0.5, "breakdown": {"word_count_score": 0.25}}, "llm_judge": {"score": 1.0}}}, "llm_results": {"a": True}})
    put("evaluations/b.yaml", {"model": "no task"})


def test_rebuild_from_result_files(spark, tmp_path):
    from quillmark.sources import schemas

    _result_files(tmp_path / "results")
    results, out = str(tmp_path / "results"), str(tmp_path / "ledger")
    assert ingest.stored(spark, out, "generations", schemas.GENERATIONS).count() == 0
    for version in (0, 1):  # a rebuild replaces, it doesn't append
        assert tuple(ingest.rebuild(spark, results, out).first()) == (2, 2, 1, version, 6)
    g = {r.task_type: r for r in ingest.stored(spark, out, "generations", schemas.GENERATIONS).collect()}
    assert (g["beat_revision"].generation_cost, g["beat_revision"].prompt_tokens, g["beat_revision"].agentic_type) == (0.5, 3, None)
    assert (g["unknown"].generation_cost, g["unknown"].completion_tokens, g["unknown"].metrics.total_turns, g["unknown"].theory) == (0.25, 9, 2, "Unknown")
    e = {r.task_id: r for r in ingest.stored(spark, out, "evaluations", schemas.EVALUATIONS).collect()}
    one_, many = e["beat_revision_001"], e["agentic_planning_execution_001"]
    assert (one_.task_type, one_.word_count_score, one_.programmatic, one_.llm_judge, one_.output_scores, one_.llm_results) == ("unknown", 0.25, 0.5, 1.0, None, {"a": "true"})
    assert (many.task_type, many.process_scores, many.output_scores, many.evaluation_cost, many.success) == ("agentic_planning_execution", {"p": 0.25}, {"o": 0.75}, 0.1, True)
    assert [(r.turn_idx, r.turn_type) for r in ingest.stored(spark, out, "turns", schemas.TURNS).orderBy("turn_idx").collect()] == [(0, "plan_prompt"), (1, "plan")]
    assert ingest.rebuild(spark, str(tmp_path / "none"), str(tmp_path / "empty")).first()[:3] == (0, 0, 0)


def test_task_files_in_scan_order(spark, tmp_path):
    import json

    for kind, name, place in (("critique_improvement", "b.json", "word_count"), ("beat_revision", "c.json", "requirements"), ("beat_revision", "a.json", "requirements"), ("theory_conversion", "d.json", "target_requirements")):
        words = [300, 500]
        body = {"word_count": words} if place == "word_count" else {place: {"word_count": words}}
        (tmp_path / name).write_text(json.dumps({"task_id": f"{kind}_{ord(name[0])}", "task_type": kind, "theory": "Story Circle", **body}))
    t = ingest.in_scan_order(ingest.tasks(ingest.documents(spark, str(tmp_path)))).orderBy("ord").collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in t] == ["a.json", "c.json", "d.json", "b.json"]
    assert {(r.word_count_min, r.word_count_max) for r in t} == {(300, 500)}


def test_tables_swap_only_when_all_are_written(spark, tmp_path):
    out = str(tmp_path / "t")
    ingest.write_tables(out, a=spark.range(3), b=spark.range(2))
    with pytest.raises(Exception):
        ingest.write_tables(out, a=spark.range(9), b=spark.range(1).select(F.raise_error(F.lit("dies")).cast("long").alias("id")))
    assert [ingest.stored(spark, out, n, "id long").count() for n in "ab"] == [3, 2]


def test_refresh_equals_rebuild_and_parses_what_changed(spark, tmp_path):
    import json
    import os

    from quillmark.sources import schemas

    files, results = tmp_path / "results", str(tmp_path / "results")
    _result_files(files)
    out = str(tmp_path / "ledger")
    tables = {"generations": schemas.GENERATIONS, "evaluations": schemas.EVALUATIONS, "turns": schemas.TURNS, "unreadable": "file_path string"}

    def same_as_rebuilt(n):
        ingest.rebuild(spark, results, str(tmp_path / f"whole{n}"))
        for name, schema in tables.items():
            a, b = (sorted(map(str, ingest.stored(spark, p, name, schema).collect())) for p in (out, str(tmp_path / f"whole{n}")))
            assert a == b, name
        listed = [sorted((r.kind, r.path, r.digest) for r in ingest.stored(spark, p, "manifest", ingest.MANIFEST).collect()) for p in (out, str(tmp_path / f"whole{n}"))]
        assert listed[0] == listed[1]

    refreshed = lambda: tuple(ingest.refresh(spark, results, out).first())
    assert refreshed() == (2, 2, 1, 0, 6)  # the first one reads everything
    assert refreshed() == (2, 2, 1, 0, 0)  # nothing changed: no version
    (files / "generations/b.yaml").write_text(json.dumps({"task_id": "t_001", "model": "c/n"}))  # was broken
    (files / "evaluations/[odd] name.yaml").write_text(json.dumps({"task_id": "t_001", "model": "c/n", "final_score": 1.0}))
    assert refreshed() == (3, 3, 0, 1, 2)
    same_as_rebuilt(1)
    again = (files / "generations/a.yaml").read_text()
    (files / "generations/a.yaml").write_text(again)
    os.utime(files / "generations/a.yaml", (10**9, 10**9))  # touched, with the same bytes
    assert refreshed() == (3, 3, 0, 1, 0)
    os.remove(files / "agentic/gen_a.yaml")
    (files / "evaluations/a.yaml").write_text("{broken now")
    assert refreshed() == (2, 2, 1, 2, 1)
    same_as_rebuilt(2)
    assert ingest.stored(spark, out, "turns", schemas.TURNS).count() == 0


def test_two_writers_of_tables(spark, tmp_path, monkeypatch):
    """Both full refreshes get a version; a refresh from changes starts again from what another writer left."""
    from quillmark.sources import schemas

    out = str(tmp_path / "plain")
    one, two = spark.range(1), spark.range(2)
    assert [ingest.write_tables(out, a=t) for t in (one, two)] == [0, 1]
    with pytest.raises(ingest.Conflict):
        ingest.write_tables(out, 0, a=one)
    assert ingest.stored(spark, out, "a", "id long").count() == 2 and ingest.live_version(spark, out) == 1
    for n in range(5):
        ingest.write_tables(out, a=one)
    assert len(list((tmp_path / "plain").glob("tables-*"))) == ingest.KEEP

    _result_files(tmp_path / "results")
    results, out = str(tmp_path / "results"), str(tmp_path / "ledger")
    ingest.rebuild(spark, results, out)
    (tmp_path / "results/evaluations/c.yaml").write_text('{"task_id": "t_001", "model": "c/n", "final_score": 1.0}')
    write, inside = ingest.write_tables, []

    def interrupted(path, *args, **tables):
        if args and not inside:
            inside.append(1)
            ingest.rebuild(spark, results, out)  # the other writer is first
        return write(path, *args, **tables)

    monkeypatch.setattr(ingest, "write_tables", interrupted)
    assert ingest.refresh(spark, results, out).first()[:4] == (2, 3, 1, 1)
    assert ingest.stored(spark, out, "evaluations", schemas.EVALUATIONS).count() == 3


def test_score_maps_keep_numbers_only(spark):
    maps = ['{"a":0.5,"b":"text","c":true}', '{"a":1,"b":null,"c":{"d":2},"e":[1],"f":false,"g":1e-3}', "{}", '"text"', None, "{broken"]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m string")
    got = {r.i: (r.n, r.mean) for r in rows.select("i", ingest.numbers_of(F.col("m")).alias("n")).select("i", "n", judge.map_mean(F.col("n")).alias("mean")).collect()}
    assert got[0] == ({"a": 0.5, "c": 1.0}, 0.75) and got[1][0] == {"a": 1.0, "f": 0.0, "g": 0.001} and got[2] == ({}, None)
    assert [got[i] for i in (3, 4, 5)] == [(None, None)] * 3


def test_reports(spark, tmp_path):
    from quillmark.sources import adapters

    sf = "/root/testdata/sf0.001"
    evaluations, generations, tasks, flags = (f(spark, sf) for f in (adapters.evaluations, adapters.generations, adapters.tasks, adapters.pass_flags))
    report.write_report(str(tmp_path), flags, evaluations, generations, tasks)
    analysis = "\n".join(r.value for r in spark.read.text(str(tmp_path / "task_analysis")).collect())
    assert analysis.count("\n## ") == 7 and "| 1 | " in analysis.split("## Hardest tasks")[1]
    assert spark.read.json(str(tmp_path / "insights")).where("insight = 'weakest_task_type'").count() == 2
    assert spark.read.json(str(tmp_path / "statistical_comparisons")).count() == 45
    cells = aggregates.cell_scores(evaluations)
    summary = report.console_summary(aggregates.summary(evaluations, generations), aggregates.model_scores(cells, "task_type"), ["x/judge-0"])
    assert "Judged by judge-0." in summary and "| 10 | model-" in summary and "| 11 | " not in summary and summary.count("| beat_revision |") == 1
    gpt = spark.createDataFrame([("openai/gpt-x", 0.0, 1, 0.5), ("c/claude-y", 0.5, 1, 0.25)], "model string, avg_score double, total long, generation_cost double")
    shown = {r.name: (r.place, r.score_pct) for r in report.summary_rows(gpt, gpt.select("model", F.lit("t").alias("task_type"), "avg_score")).where("part = 'ranking'").collect()}
    assert shown == {"Claude y": ("1", 50.0), "GPT-x": ("2", None)}
    many = spark.range(1001).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("model"), F.lit("t_1").alias("task_id"), F.lit("t").alias("task_type"), F.lit(0.5).alias("score"), F.lit(1).alias("evaluations"))
    with pytest.raises(ValueError):
        report.task_analysis_markdown(aggregates.task_stats(many, tasks, generations), many)
    with pytest.raises(ValueError):
        report.markdown_table(spark.range(4), most=3)
    assert report.number(1234567) == "1,234,567"


# The published leaderboard: model, score, cost, value.
GOLDEN_TOP = [
    ("deepseek-v3.2", "92.2%", "0.1978", "430.2"),
    ("claude-opus-4.5", "90.9%", "2.8457", "29.0"),
    ("claude-sonnet-4.5", "90.1%", "1.7390", "46.6"),
    ("claude-sonnet-4", "89.6%", "1.5932", "50.4"),
    ("o3", "89.5%", "0.9582", "83.6"),
    ("glm-4.7", "88.8%", "0.6058", "130.3"),
    ("kimi-k2-thinking", "88.7%", "0.5782", "136.1"),
    ("gemini-3-flash-preview", "88.3%", "0.5896", "132.4"),
    ("minimax-m2.1", "86.9%", "0.3793", "199.3"),
    ("claude-haiku-4.5", "86.9%", "0.6956", "108.5"),
    ("o3-mini", "86.9%", "0.5620", "134.3"),
    ("deepseek-r1", "86.7%", "0.4157", "180.9"),
    ("gemini-2.5-flash", "85.7%", "0.4177", "175.8"),
    ("gpt-4o", "85.6%", "0.8069", "90.9"),
    ("grok-4", "85.5%", "1.8858", "38.7"),
    ("gemini-3-pro-preview", "85.3%", "2.1086", "34.5"),
    ("qwen3-235b-a22b", "84.5%", "0.2177", "327.9"),
    ("mistral-small-creative", "84.3%", "0.2119", "335.2"),
    ("gpt-5", "82.0%", "1.6176", "41.6"),
    ("gpt-4o-mini", "81.7%", "0.1829", "364.7"),
    ("gpt-5.2", "80.3%", "1.7564", "36.7"),
    ("gpt-5.1", "78.5%", "1.5230", "40.5"),
    ("minimax-m2", "77.1%", "0.3116", "190.7"),
    ("ministral-14b-2512", "77.1%", "0.1906", "311.6"),
    ("llama-4-maverick", "72.2%", "0.1938", "268.8"),
]


@pytest.mark.skipif("QUILLMARK_RESULTS" not in os.environ, reason="no folder of result files is given")
def test_published_tables(spark, tmp_path):
    """Ingest of the published result files gives the published leaderboard, costs and counts."""
    out = str(tmp_path / "ledger")
    from quillmark.sources import schemas

    found = ingest.rebuild(spark, os.environ["QUILLMARK_RESULTS"], out).first()
    assert (found.generations, found.evaluations, found.unreadable) == (850, 2553, 0)
    evaluations, generations = ingest.stored(spark, out, "evaluations", schemas.EVALUATIONS), ingest.stored(spark, out, "generations", schemas.GENERATIONS)
    summary = aggregates.summary(evaluations, generations)
    values = {r.model_short: r.value for r in ranking.value_ranking(summary).withColumn("model_short", names.short_name(F.col("model"))).collect()}
    ranked = ranking.leaderboard(summary).orderBy("rank").collect()
    assert [(r.model_short, f"{r.avg_score:.1%}", f"{r.generation_cost:.4f}", f"{values[r.model_short]:.1f}") for r in ranked] == GOLDEN_TOP
    assert [r.company for r in ranked if r.model_short == "glm-4.7"] == ["Z-Ai"]
