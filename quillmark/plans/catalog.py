"""Registered queries of the evaluation engine; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import judge, names, patterns, rules, schema, text
from ..operators import aggregates as agg
from ..operators import generate, incremental, ledger, ordering, ranking, report, selection, stats, turns
from ..sources import adapters, ingest
from ..streaming import conversation_stream, ledger_stream
from . import oracle

Query = Callable[..., DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _found}


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def _cells(spark, sf) -> DataFrame:
    return agg.cell_scores(adapters.evaluations(spark, sf))


def _breakdown(spark, sf) -> DataFrame:
    return agg.cell_breakdown(adapters.evaluations(spark, sf))


def _summary(spark, sf) -> DataFrame:
    return agg.summary(adapters.evaluations(spark, sf), adapters.generations(spark, sf))


def _stats(spark, sf) -> DataFrame:
    return agg.task_stats(_cells(spark, sf), adapters.tasks(spark, sf), adapters.generations(spark, sf))


def _documents(spark, sf) -> DataFrame:
    return adapters.spread(adapters.table(spark, sf, "documents").select("doc_id", "text"))


@query
def leaderboard(spark, sf):
    r = ranking.leaderboard(_summary(spark, sf))
    return rounded(r.select("rank", "model", "model_short", "company", "avg_score", "generation_cost", "total"), "avg_score", "generation_cost")


@query
def cell_scores(spark, sf):
    return rounded(_cells(spark, sf), "score")


@query
def range_medians(spark, sf):
    """Medians of four large groups of continuous values, by range counting."""
    t = adapters.table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")))
    return rounded(selection.by_ranges(t, ("l_returnflag", "l_linestatus"), "price"), "median", digits=4)


@query
def cell_breakdown(spark, sf):
    parts = ("word_count", "programmatic", "llm_judge", "process", "output")
    return rounded(_breakdown(spark, sf).select("model", "task_id", *parts), *parts)


@query
def model_components(spark, sf):
    return rounded(agg.model_components(_breakdown(spark, sf)), *[f"avg_{c}" for c in agg.COMPONENTS])


@query
def model_task_type_scores(spark, sf):
    return rounded(agg.model_scores(_cells(spark, sf), "task_type"), "avg_score")


@query
def model_task_type_components(spark, sf):
    return rounded(agg.model_components(_breakdown(spark, sf), "task_type"), *[f"avg_{c}" for c in agg.COMPONENTS], digits=9)


@query
def model_costs(spark, sf):
    return rounded(agg.model_costs(adapters.generations(spark, sf)), "generation_cost", "avg_cost_per_task")


@query
def value_ranking(spark, sf):
    return rounded(ranking.value_ranking(_summary(spark, sf)).select("rank", "model", "value"), "value")


@query
def cost_efficiency(spark, sf):
    return rounded(agg.cost_efficiency(agg.model_costs(adapters.generations(spark, sf))), "reasoning_pct", "cost_per_1k_output")


@query
def score_matrix(spark, sf):
    return rounded(ranking.matrix(agg.model_scores(_cells(spark, sf), "task_type"), "model", "task_type", "avg_score"), *K.TASK_TYPES)


@query
def heat_map(spark, sf):
    return rounded(ranking.heat_map(agg.model_scores(_cells(spark, sf), "task_type"), "model", "task_type", "avg_score"), *K.TASK_TYPES)


@query
def task_model_matrix(spark, sf):
    models = [f"{adapters.COMPANIES[m % 5]}/model-{m:02d}" for m in range(25)]
    return rounded(ranking.matrix(_cells(spark, sf), "task_id", "model", "score", models), *models)


@query
def task_stats(spark, sf):
    return rounded(_stats(spark, sf), "avg_score", "min_score", "max_score", "spread", "stdev", "total_cost", "avg_cost")


@query
def task_type_discrimination(spark, sf):
    return rounded(agg.discrimination(_stats(spark, sf)), "avg_score", "avg_spread", "max_spread")


@query
def task_type_costs(spark, sf):
    return rounded(agg.task_type_costs(_stats(spark, sf)), "total_cost", "avg_cost")


def _top(spark, sf, by: str, ascending: bool) -> DataFrame:
    t = ranking.top_tasks(_stats(spark, sf), by, 10, ascending)
    return rounded(t.select("rank", "task_id", "avg_score", "spread", "best_model", "worst_model"), "avg_score", "spread")


@query
def top_discriminative(spark, sf):
    return _top(spark, sf, "spread", False)


@query
def hardest(spark, sf):
    return _top(spark, sf, "avg_score", True)


@query
def easiest(spark, sf):
    return _top(spark, sf, "avg_score", False)


@query
def task_details(spark, sf):
    return rounded(ranking.details(_stats(spark, sf)).select("task_type", "task_id", "spread", "place"), "spread")


@query
def best_by_type(spark, sf):
    cells = _cells(spark, sf)
    ranked = ranking.leaderboard(agg.model_scores(cells))
    return rounded(ranking.best_by_type(agg.model_scores(cells, "task_type"), ranked), "avg_score")


@query
def pareto_frontier(spark, sf):
    return rounded(ranking.frontier(_summary(spark, sf)).select("model", "generation_cost", "avg_score", "on_frontier"), "generation_cost", "avg_score")


@query
def marker_sizes(spark, sf):
    points = _summary(spark, sf).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return rounded(ranking.marker_sizes(points).select("model", "marker"), "marker")


@query
def contributions(spark, sf):
    return rounded(ranking.contributions(agg.model_components(_breakdown(spark, sf))), "programmatic_part", "llm_judge_part")


def _evaluators(spark, sf) -> DataFrame:
    """The judges of the ledger and a new one, which has judged nothing."""
    new = spark.createDataFrame([("judge-new",)], "evaluator_model string")
    return adapters.evaluations(spark, sf).select("evaluator_model").distinct().unionByName(new)


def _models(spark, sf) -> DataFrame:
    """The models of the ledger and a new one, which has generated nothing."""
    return adapters.models(spark, sf).unionByName(spark.createDataFrame([("acme-labs/model-new",)], "model string"))


@query
def missing_generations(spark, sf):
    return ledger.missing_generations(adapters.tasks(spark, sf), _models(spark, sf), adapters.generations(spark, sf))


@query
def missing_evaluations(spark, sf):
    return ledger.missing_evaluations(adapters.generations(spark, sf), _evaluators(spark, sf), adapters.evaluations(spark, sf))


@query
def work_estimate(spark, sf):
    work = ledger.missing_work(adapters.tasks(spark, sf), _models(spark, sf), adapters.generations(spark, sf), _evaluators(spark, sf), adapters.evaluations(spark, sf))
    return rounded(ledger.work_estimate(work), "estimated_cost")


@query
def forced_generations(spark, sf):
    return ledger.planned_generations(adapters.tasks(spark, sf), _models(spark, sf), adapters.generations(spark, sf), force=True)


@query
def planned_after_purge(spark, sf):
    """What a run plans: failed generations of its models go first, the rest that is missing follows."""
    mine = adapters.models(spark, sf).where("model like 'openai/%'")
    kept = ledger.purge_models(adapters.generations(spark, sf), mine)
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("kept"), F.count_if(~F.col("success")).alias("failed"))


@query
def purge_counts(spark, sf):
    """How many failed rows a purge removes: of one model's generations, and of all evaluations."""
    g = ledger.removed_count(adapters.generations(spark, sf), "anthropic/model-00").select(F.lit("generations").alias("ledger"), "removed")
    return g.unionByName(ledger.removed_count(adapters.evaluations(spark, sf)).select(F.lit("evaluations").alias("ledger"), "removed"))


@query
def purge_failed_evaluations(spark, sf):
    kept = ledger.purge_failed(adapters.evaluations(spark, sf))
    return kept.groupBy("evaluator_model").agg(F.count(F.lit(1)).alias("kept"), F.sum("sample").alias("samples"))


@query
def upsert_latest(spark, sf):
    events, keys, order = adapters.ledger_events(spark, sf), ("user_id", "event_type"), (F.desc("ts"), F.desc("event_id"))
    stored, batch = (ledger.latest(events.where(c), keys, *order) for c in ("event_id % 3 <> 0", "event_id % 3 = 0"))
    return ledger.upsert(stored, batch, keys).select("user_id", "event_type", "event_id")


@query
def purge_failed(spark, sf):
    return ledger.purge_failed(adapters.generations(spark, sf), "anthropic/model-00").select("task_id", "model", "sample")


@query
def ledger_totals(spark, sf):
    return rounded(ledger.totals(adapters.generations(spark, sf), adapters.evaluations(spark, sf)), "generation_cost", "evaluation_cost", "total_cost", digits=4)


@query
def status(spark, sf):
    s = agg.status(adapters.evaluations(spark, sf), adapters.generations(spark, sf))
    return s.select(F.array_join("models", ",").alias("models"), "tasks", "generations", F.array_join("evaluators", ",").alias("evaluators"), "evaluations")


@query
def generation_cost_report(spark, sf):
    r = rounded(agg.generation_report(adapters.generations(spark, sf), "model"), "cost", digits=4)
    return rounded(r, "success_rate")


@query
def generation_type_report(spark, sf):
    return rounded(agg.generation_report(adapters.generations(spark, sf), "task_type").select("task_type", "total", "successes", "cost"), "cost", digits=4)


@query
def evaluation_report(spark, sf):
    return rounded(rounded(agg.evaluation_report(adapters.evaluations(spark, sf), "model"), "avg_score"), "cost", digits=4)


def _rates(spark, sf) -> DataFrame:
    return agg.pass_rates(adapters.pass_flags(spark, sf))


@query
def pass_rates_grouping_sets(spark, sf):
    return rounded(_rates(spark, sf).select("scope", "model", "task_type", "n", "passed", "rate", "variance", "std"), "rate", "variance", "std")


@query
def pass_rate_matrix(spark, sf):
    langs = ["de", "en", "es", "fr"]
    return rounded(ranking.matrix(_rates(spark, sf).where("scope = 'model_task_type'"), "model", "task_type", "rate", langs), *langs)


@query
def extreme_types(spark, sf):
    return rounded(ranking.extreme_types(_rates(spark, sf)), "rate")


@query
def model_gaps(spark, sf):
    return rounded(ranking.model_gaps(_rates(spark, sf)), "gap")


@query
def pairwise_ttest(spark, sf):
    return rounded(stats.pairwise(_cells(spark, sf)).select("model_a", "model_b", "n_a", "n_b", "difference", "t"), "difference", "t")


@query
def cohens_d(spark, sf):
    return rounded(stats.pairwise(_cells(spark, sf)).select("model_a", "model_b", "cohens_d", "effect"), "cohens_d")


@query
def p_values(spark, sf):
    """Student's p by the incomplete beta function."""
    return rounded(stats.with_p_values(stats.pairwise(_cells(spark, sf))).select("model_a", "model_b", "t", "df", "p", "significant"), "t", "p")


@query
def word_count(spark, sf):
    return _documents(spark, sf).select("doc_id", text.word_count(F.col("text")).alias("words"))


@query
def word_count_scores(spark, sf):
    d = _documents(spark, sf).select("doc_id", text.word_count(F.col("text")).alias("n"))
    return rounded(d.select("doc_id", *[text.word_count_score(F.col("n"), F.lit(300), F.lit(500), m).alias(m) for m in text.METHODS]), *text.METHODS)


@query
def tokens(spark, sf):
    t = _documents(spark, sf).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"), F.try_element_at("t", F.lit(1)).alias("first_token"))


@query
def sentences(spark, sf):
    return _documents(spark, sf).select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"))


@query
def repetition_score(spark, sf):
    return rounded(text.repetition_scores(_documents(spark, sf)), "repetition_score")


@query
def slop_score(spark, sf):
    """By the operator's own words and phrases."""
    return rounded(_documents(spark, sf).select("doc_id", text.slop_score(F.col("text")).alias("slop_score")), "slop_score")


@query
def slop_score_own_lists(spark, sf):
    """By lists that a caller gives: frequent words of the test documents."""
    own = text.slop_score(F.col("text"), {"the": 2.0, "of": 1.0, "and": 1.0, "la": 2.0, "der": 1.0, "de": 1.0}, {"of the": 2.0, "the th": 1.0})
    return rounded(_documents(spark, sf).select("doc_id", own.alias("slop_score")), "slop_score")


@query
def programmatic_score(spark, sf):
    t = F.col("text")
    fits = text.word_count_score(text.word_count(t), F.lit(300), F.lit(500))
    d = _documents(spark, sf).select("doc_id", fits.alias("fits"), text.repetition_and_slop(t).alias("s"))
    return rounded(d.select("doc_id", text.programmatic_score(F.col("fits"), F.col("s.repetition"), F.col("s.slop")).alias("programmatic")), "programmatic")


def _judge_results() -> Column:
    """Judge maps with numbers, booleans, junk and missing keys."""
    pairs = []
    for i, (k, key) in enumerate(oracle.JUDGE_KEYS.items()):
        value = F.expr(key).cast("string")
        mod = F.col("doc_id") % (5 + i)
        pairs.append(F.struct(F.lit(f"{k}_score").alias("k"), F.when(mod == 0, "8/10").when(mod == 1, "true" if i % 2 else None).otherwise(value).alias("v")))
    return F.map_from_entries(F.array(*pairs))


@query
def judge_score(spark, sf):
    d = adapters.table(spark, sf, "documents").select("doc_id", _judge_results().alias("results"))
    return rounded(d.select("doc_id", judge.judge_score("beat_interpolation", F.col("results")).alias("judge")), "judge")


@query
def judge_scores(spark, sf):
    """Every single-turn type's weights, both kinds of revision: one row for each document and kind."""
    kinds = []
    for kind in K.JUDGE_WEIGHTS:
        keys = [f"{k}_score" for k in K.JUDGE_WEIGHTS[kind]]
        values = [F.struct(F.lit(k).alias("k"), F.when(F.col("doc_id") % (5 + i) != 0, ((F.col("doc_id") * (17 + 3 * i) % 11) / 10.0).cast("string")).alias("v")) for i, k in enumerate(keys)]
        kinds.append(F.struct(F.lit(kind).alias("kind"), judge.judge_score(kind.split("/")[0], F.map_from_entries(F.array(*values))).alias("judge")))
    d = adapters.table(spark, sf, "documents").select("doc_id", F.explode(F.array(*kinds)).alias("x"))
    return rounded(d.select("doc_id", "x.kind", "x.judge"), "judge")


@query
def agentic_kinds(spark, sf):
    """Every multi-turn kind: one row for each document and kind."""
    kinds = []
    for kind, (_, keys) in K.AGENTIC_SCORES.items():
        values = [F.struct(F.lit(k).alias("k"), F.when(F.col("doc_id") % (3 + i) != 0, ((F.col("doc_id") * (i + 2) % 11) / 10.0).cast("string")).alias("v")) for i, k in enumerate((*keys, *K.AGENTIC_OUTPUTS))]
        kinds.append(F.struct(F.lit(kind).alias("kind"), judge.agentic_result(kind, F.map_from_entries(F.array(*values))).alias("scores")))
    d = adapters.dealt(adapters.table(spark, sf, "documents").select("doc_id")).select("doc_id", F.explode(F.array(*kinds)).alias("x"))
    means = d.select("doc_id", "x.kind", judge.map_mean(F.col("x.scores.process")).alias("process"), judge.map_mean(F.col("x.scores.output")).alias("output"), "x.scores.final")
    return rounded(means, "process", "output", "final")


@query
def final_score(spark, sf):
    w = text.word_count_score(text.word_count(F.col("text")), F.lit(300), F.lit(500))
    d = _documents(spark, sf).select("doc_id", w.alias("w"), _judge_results().alias("results"))
    return rounded(d.select("doc_id", text.final_score(F.col("w"), judge.judge_score("beat_interpolation", F.col("results"))).alias("final")), "final")


@query
def order_ranks(spark, sf):
    """The rank of every order by price, and whether any earlier order was dearer: ranks and running maxima over a large table."""
    o = adapters.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day"))
    ranked = ordering.with_row_number(o, -F.col("o_totalprice"), "o_orderkey")
    record = ordering.with_running_max(ranked, F.col("day"), F.col("o_totalprice"), "o_orderkey", name="before")
    return record.select("o_orderkey", "rank", (F.col("before").isNull() | (F.col("o_totalprice") > F.col("before"))).alias("record"))


@query
def conversation_summaries(spark, sf):
    """Whole conversations as arrays of turns, summarised as a stream of them is when they close."""
    t = adapters.turns(spark, sf).withColumns({"prompt_tokens": F.length("role").cast("long"), "completion_tokens": F.length("content").cast("long"), "cost": F.col("turn_idx") * 0.25})
    s = conversation_stream.summaries(conversation_stream.gathered(t))
    return s.select("generation_id", "total_turns", "questions_asked", "revision_count", "prompt_tokens", "completion_tokens", F.round("cost", 6).alias("cost"), F.size("questions").alias("questions"), F.md5(F.element_at("questions", 1)["answer"]).alias("first_answer_md5"), F.md5("output").alias("output_md5"))


@query
def kept_evaluation_report(spark, sf):
    """The report by model after an upsert, from the facts before it and the rows that went and came."""
    rows = adapters.evaluations(spark, sf)
    keys, measures = incremental.EVALUATION_KEYS, incremental.evaluation_measures()
    again = rows.where("evaluator_model = 'judge-1'")  # judged again: the first score went, half of it came
    feed = again.select(F.struct("*").alias("before"), F.struct(*[F.col(c) / 2 if c == "final_score" else F.col(c) for c in rows.columns]).alias("after")).select("before", F.col("after").cast(again.select(F.struct("*").alias("x")).schema["x"].dataType).alias("after"))
    now = incremental.updated(incremental.facts(rows, keys, measures), feed, keys, measures)
    return rounded(rounded(incremental.evaluation_report(now, "model"), "avg_score"), "cost", digits=4)


@query
def question_answer_pairs(spark, sf):
    q = turns.question_answers(adapters.turns(spark, sf))
    return q.select("generation_id", "turn_idx", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query
def turn_metrics(spark, sf):
    return turns.turn_metrics(adapters.turns(spark, sf))


@query
def last_generation(spark, sf):
    return turns.last_generation(adapters.turns(spark, sf)).select("generation_id", "turn_idx", F.md5("output").alias("output_md5"))


@query
def first_question(spark, sf):
    return turns.first_plan(adapters.turns(spark, sf), "question")


@query
def revision_trajectory(spark, sf):
    return turns.trajectory(adapters.turns(spark, sf))


@query
def critique_trajectory(spark, sf):
    """The critique variant's own limits: the first four versions, 400 characters each."""
    return turns.trajectory(adapters.turns(spark, sf), most=4, width=400)


@query
def token_rollup(spark, sf):
    facts = adapters.turns(spark, sf).select("generation_id", (F.col("turn_idx") * 10 + 5).alias("prompt_tokens"), F.length("content").alias("completion_tokens"), (F.col("turn_idx") * 0.25).alias("cost"))
    return rounded(turns.token_rollup(facts), "cost")


@query
def keyword_match(spark, sf):
    constraint = lambda answer, *patterns: F.struct(F.array(*map(F.lit, patterns)).alias("patterns"), F.lit(answer).alias("answer"))
    constraints = F.array(constraint("YES", "the", "der"), constraint("MAYBE", "LA"))
    return adapters.turns(spark, sf).where("turn_type = 'question'").select("generation_id", "turn_idx", turns.keyword_answer(F.col("content"), constraints).alias("answer"))


def _benchmark_words(spark, sf) -> list[str]:
    """The different words of at least five letters in the benchmark, which is a small table."""
    words = adapters.table(spark, sf, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("w")).where(F.length("w") >= 5)
    return [r.w for r in words.distinct().orderBy("w").limit(patterns.MOST + 1).collect()]


@query
def phrase_hits(spark, sf):
    """How many of the benchmark's words, and how often, stand anywhere inside each turn of a conversation."""
    turn = adapters.spread(adapters.table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    found = turn.select("conv_id", "turn", patterns.phrase_counts(F.col("text"), _benchmark_words(spark, sf)).alias("m"))
    return found.select("conv_id", "turn", F.size("m").alias("phrases"), F.aggregate(F.map_values("m"), F.lit(0), lambda a, x: a + x).alias("hits"))


@query
def pattern_answers(spark, sf):
    """Answers of many constraints at once: each word of the benchmark is a pattern of one of 50 constraints, the first one wins."""
    rules = [(f"C{k:02d}", words) for k in range(50) if (words := _benchmark_words(spark, sf)[k::50])]
    asked = adapters.turns(spark, sf).where("turn_type = 'question'")
    return asked.select("generation_id", "turn_idx", patterns.first_rule(F.col("content"), rules).alias("answer"))


#: A schema of the JSON that ``order_schema`` makes of orders: items with rules of their own, references and conditions.
ORDER_SCHEMA = {
    "$schema": "http://json-schema.org/draft-07/schema#",
    "definitions": {"line": {"type": "object", "required": ["mode", "quantity"], "properties": {"mode": {"enum": ["A", "N"]}, "quantity": {"type": "number", "minimum": 1, "maximum": 45}, "discount": {"type": "number", "exclusiveMaximum": 0.09}}, "additionalProperties": False}},
    "type": "object",
    "required": ["key", "status", "lines"],
    "properties": {"key": {"type": "integer"}, "status": {"type": "string", "pattern": "^[FOP]$"}, "lines": {"type": "array", "minItems": 2, "items": {"$ref": "#/definitions/line"}}},
    "allOf": [{"if": {"properties": {"status": {"const": "F"}}}, "then": {"required": ["closed"]}, "else": {"not": {"required": ["closed"]}}}],
}


@query
def order_schema(spark, sf):
    """Violations of a JSON schema by whole orders: what each line breaks, too few lines, and dates that the status doesn't allow."""
    lines = adapters.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("mode"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))).alias("lines"))
    o = adapters.table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    closed = F.when(F.col("o_totalprice") > 100_000, F.col("o_orderdate").cast("string"))
    document = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), "lines", closed.alias("closed")))
    return o.select("o_orderkey", F.size(schema.violations(document, ORDER_SCHEMA)).alias("violations"))


@query
def oracle_answers(spark, sf):
    replies = F.array(*map(F.lit, ["none of them", "constraint 2", "Yes, that holds", "maybe", "99", "#1."]))
    reply = F.element_at(replies, (F.col("event_id") % 6 + 1).cast("int"))
    return adapters.table(spark, sf, "events").select("event_id", turns.oracle_answer(reply, F.array(F.lit("A"), F.lit("B"))).alias("answer"))


@query
def json_extract(spark, sf):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("It is "), "props", F.lit(" I think")))
    return adapters.table(spark, sf, "events").select("event_id", judge.safe_float(F.get_json_object(judge.extract_json(wrapped), "$.k"), 0.5).alias("k"))


@query
def safe_float(spark, sf):
    e = F.col("event_id") % 10
    raw = F.when(e == 0, F.col("value").cast("string")).when(e == 1, "True").when(e == 2, "false").when(e == 3, "8/10").when(e == 4, "1d").when(e == 5, "0.8f").when(e == 6, " 2.5 ").when(e == 7, "1_0").when(e == 8, "-.5e1")
    return rounded(adapters.table(spark, sf, "events").select("event_id", judge.safe_float(raw, 0.5).alias("v")), "v")


@query
def company_rollup(spark, sf):
    g = _summary(spark, sf).groupBy(names.company_name(F.col("model")).alias("company")).agg(F.count(F.lit(1)).alias("models"), F.avg("avg_score").alias("avg_score"), F.sum("generation_cost").alias("cost"))
    return rounded(rounded(g, "avg_score"), "cost", digits=4)


@query
def token_limits(spark, sf):
    most, reasoning = names.token_limits(F.col("task_type"))
    return adapters.generations(spark, sf).select("task_type").distinct().select("task_type", most.alias("max_tokens"), reasoning.alias("max_reasoning"))


@query
def response_class(spark, sf):
    d = F.col("doc_id")
    finish = F.when(d % 3 == 0, "stop").when(d % 3 == 2, "length")
    c = text.response_class(F.lit(1000), d % 1200, F.when(d % 4 == 0, "  ").otherwise(F.col("text")), finish)
    return _documents(spark, sf).select("doc_id", c.alias("class"))


@query
def error_rates(spark, sf):
    return ledger_stream.error_rates(adapters.ledger_events(spark, sf))


@query
def continuation_pass(spark, sf):
    d = F.col("doc_id")
    checks = F.create_map(F.lit("a"), d % 2 == 0, F.lit("b"), d % 3 == 0, F.lit("c"), d % 5 != 0, F.lit("d"), F.lit(True), F.lit("e"), F.lit(True))
    return adapters.table(spark, sf, "documents").select("doc_id", rules.continuation_pass(checks).alias("pass"))


@query
def synthesis_pass(spark, sf):
    d = F.col("doc_id")
    nested = F.when(d % 4 != 0, F.create_map(F.lit("x"), F.create_map(F.lit("p"), d % 2 == 0, F.lit("q"), F.lit(True)), F.lit("y"), F.create_map(F.lit("r"), F.lit(True))))
    cross, overall = F.when(d % 7 != 0, F.create_map(F.lit("m"), d % 3 == 0)), F.when(d % 11 != 0, d % 5 != 0)
    return adapters.table(spark, sf, "documents").select("doc_id", rules.synthesis_pass(cross, nested, overall).alias("pass"))


@query
def pass_by_type(spark, sf):
    """The rule of each row's own task type, over types with and without one."""
    d = F.col("doc_id")
    criteria = list(dict.fromkeys((*K.INTERPOLATION_CRITERIA, *K.REVISION_CRITERIA, *K.CONVERSION_CRITERIA)))
    flags = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), (d % (i + 2) != 1).alias("v")) for i, k in enumerate(criteria)]))
    results = F.struct(
        flags.alias("flags"), F.create_map(F.lit("a"), d % 2 == 0, F.lit("b"), F.lit(True)).alias("constraints_checked"), F.create_map(F.lit("m"), d % 3 == 0).alias("cross_beat_constraints"),
        F.lit(None).cast("map<string,map<string,boolean>>").alias("beat_requirements"), ((d % 10) / 10).alias("structural_accuracy_score"), (d % 5 != 0).alias("overall_pass"),
    )
    kind = F.element_at(F.array(*map(F.lit, K.TASK_TYPES)), (F.floor(d / 7) % 9 + 1).cast("int"))
    return adapters.table(spark, sf, "documents").select("doc_id", rules.passes(kind, results).alias("pass"))


#: A valid document of each kind, as JSON; the queries break some of its fields.
_CONTEXT_JSON = '"story_context":{"protagonist":"p","setting":"s","central_conflict":"c","tone":"t"}'
_PLANNED_JSON = _CONTEXT_JSON + ',"required_beats":["a"],"constraints":["b"],"word_count":[100,200]'
_TASK_JSON = {
    "beat_interpolation": '"beat_before":{"name":"a","content":"' + "x" * 100 + '"},"beat_after":{"name":"b","content":"' + "y" * 120 + '"},"missing_beat":{"name":"m"},"requirements":{"word_count":[100,200],"must_include":[]}',
    "beat_revision": '"beat_name":"a","beat_definition":"b","flawed_segment":{"content":"c","flaw_description":"d"},"requirements":{"word_count":[100,200],"preserve":[],"fix":"e"}',
    "constrained_continuation": '"story_opening":{"content":"c","current_beat":"b"},"continuation_constraints":{"next_beats":["n"],"word_count":[100,200],"must_include":[],"must_not_include":[],"tone":"t","ending_requirement":"e"}',
    "theory_conversion": '"from_theory":"a","to_theory":"b","original_segment":{"content":"c","beats":["d"]},"target_requirements":{"beats":["e"],"preserve":["f"],"word_count":[100,200]}',
    "multi_beat_synthesis": '"beats_to_generate":[{"name":"a","requirements":[]},{"name":"b","requirements":[]},{"name":"c","requirements":[]}],"cross_beat_constraints":[],' + _CONTEXT_JSON + ',"word_count":[100,200]',
    "agentic_constraint_discovery": '"agentic_type":"constraint_discovery","required_beats":[],"hidden_constraints":[],"max_questions":3,"word_count":[100,200]',
    "agentic_planning_execution": '"agentic_type":"planning_execution",' + _PLANNED_JSON,
    "agentic_iterative_revision": '"agentic_type":"iterative_revision","max_revisions":2,' + _PLANNED_JSON,
    "critique_improvement": '"agentic_type":"critique_improvement","critique_rounds":3,' + _PLANNED_JSON,
}


@query
def schema_violations(spark, sf):
    """Violations of the schema of each task type: wrong ids, theories and word ranges, and text that is no JSON."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, K.TASK_TYPES)), (k % 9 + 1).cast("int"))
    body = F.element_at(F.create_map(*[F.lit(x) for t in K.TASK_TYPES for x in (t, _TASK_JSON[t])]), kind)
    body = F.when(k % 7 == 0, F.replace(body, F.lit("[100,200]"), F.lit("[10,200]"))).otherwise(body)
    head = F.concat(F.lit('{"task_id":"'), F.when(k % 11 == 0, "Bad-1").otherwise("some_task_001"), F.lit('","task_type":"'), kind, F.lit('","theory":"'), F.when(k % 5 == 0, "Other").otherwise("Story Circle"), F.lit('",'))
    document = F.when(k % 13 == 0, "{broken").otherwise(F.concat(head, body, F.lit("}")))
    v = rules.schema_violations(document, kind, K.TASK_RULES, K.TASK_RULES_BY_TYPE)
    return adapters.dealt(adapters.table(spark, sf, "part").select("p_partkey")).select("p_partkey", F.size(v).alias("violations"))


_RESULT_JSON = {
    "beat_interpolation": '"beat_elements_present":true,"word_count_valid":true,"character_consistent":false,"logical_bridge":true,"setting_continuity":true',
    "beat_revision": '"flaw_corrected":true,"beat_definition_satisfied":true,"preserved_elements":true,"word_count_valid":true,"no_new_errors":true',
    "constrained_continuation": '"constraints_checked":{"a":true},"constraints_passed":1,"constraints_total":1,"pass_rate":0.5',
    "theory_conversion": '"target_beats_present":{},"all_target_beats_present":true,"core_preserved":true,"structural_accuracy_score":1',
    "multi_beat_synthesis": '"beat_requirements":{},"cross_beat_constraints":{},"all_cross_beat_satisfied":true,"beat_specific_pass_rate":0.7',
}


@query
def evaluation_schema(spark, sf):
    """Violations of the schema of evaluations: a flag that is text, a number out of range or of the wrong kind, an absent id."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, _RESULT_JSON)), (k % 5 + 1).cast("int"))
    body = F.element_at(F.create_map(*[F.lit(x) for pair in _RESULT_JSON.items() for x in pair]), kind)
    for old, new in (("0.5", "1.5"), ("score\":1", "score\":-1"), ("0.7", "\"0.7\""), ("passed\":1", "passed\":1.5")):
        body = F.when(k % 7 == 0, F.replace(body, F.lit(old), F.lit(new))).otherwise(body)
    passed = F.when(k % 11 == 0, '"yes"').otherwise("true")
    evaluation = F.when(k % 4 != 0, '"evaluation_id":"e",').otherwise("")
    document = F.concat(F.lit("{"), evaluation, F.lit('"task_id":"t","generation_id":"g","task_type":"'), kind, F.lit('","results":{"overall_pass":'), passed, F.lit(","), body, F.lit("}}"))
    v = rules.schema_violations(document, kind, K.EVALUATION_RULES, K.EVALUATION_RULES_BY_TYPE)
    return adapters.dealt(adapters.table(spark, sf, "part").select("p_partkey")).select("p_partkey", F.size(v).alias("violations"))


@query
def word_ranges(spark, sf):
    """Each task's own range, or its type's default for every third task."""
    t = adapters.tasks(spark, sf)
    own = [F.when(F.col(c) % 3 != 0, F.col(c)) for c in ("word_count_min", "word_count_max")]
    low, high = text.word_range(F.col("task_type"), *own)
    return t.select("task_id", low.alias("low"), high.alias("high"))


@query
def beat_budgets(spark, sf):
    a, b = text.beat_budget(F.col("word_count_min"), F.col("word_count_max"), F.lit(3))
    return adapters.tasks(spark, sf).select("task_id", a.alias("low"), b.alias("high"))


@query
def words_in_range(spark, sf):
    n = text.word_count(F.col("text"))
    return _documents(spark, sf).select("doc_id", n.between(300, 500).alias("fits"))


@query
def first_tasks(spark, sf):
    """A task scan by type in the fixed order, first five."""
    t = adapters.tasks(spark, sf).where(F.col("task_type").isin("beat_revision", "critique_improvement"))
    kind = F.array_position(F.array(*map(F.lit, K.TASK_TYPES)), F.col("task_type"))
    return t.orderBy(kind, "task_id").limit(5).select("task_id", "task_type")


@query
def agentic_scores(spark, sf):
    d = F.col("doc_id")
    m = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), F.when(d % (3 + i) != 0, ((d * (i + 2) % 11) / 10.0).cast("string")).alias("v")) for i, k in enumerate((*K.AGENTIC_SCORES["planning_execution"][1], *K.AGENTIC_OUTPUTS))]))
    process, output, final = judge.agentic_scores("planning_execution", m)
    docs = adapters.table(spark, sf, "documents")
    return rounded(docs.select("doc_id", judge.map_mean(process).alias("process"), judge.map_mean(output).alias("output"), final.alias("final")), "process", "output", "final")


@query
def interpolation_pass(spark, sf):
    d = F.col("doc_id")
    r = F.struct(*[(F.when(d % (7 + i) != 0, d % (2 + i) != 1)).alias(f"c{i}") for i in range(5)])
    return adapters.table(spark, sf, "documents").select("doc_id", rules.interpolation_pass(r, tuple(f"c{i}" for i in range(5))).alias("pass"))


@query
def revision_pass(spark, sf):
    d = F.col("doc_id")
    r = F.struct(*[(F.when(d % (7 + i) != 0, d % (2 + i) != 1)).alias(f"c{i}") for i in range(5)])
    return adapters.table(spark, sf, "documents").select("doc_id", rules.revision_pass(r, ("c0", "c1"), ("c2", "c3", "c4")).alias("pass"))


@query
def conversion_pass(spark, sf):
    d = F.col("doc_id")
    return adapters.table(spark, sf, "documents").select("doc_id", rules.conversion_pass(d % 2 == 0, F.when(d % 5 != 0, d % 3 == 0), F.when(d % 7 != 0, (d % 10) / 10)).alias("pass"))


@query
def generation_tasks(spark, sf):
    """Generations with their task's attributes; generations of tasks that nothing names would be skipped."""
    g = adapters.generations(spark, sf).select("task_id", "model", "sample")
    j = g.join(adapters.tasks(spark, sf).select("task_id", "theory"), "task_id")
    return j.groupBy("theory").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("models"))


@query
def feedback_rounds(spark, sf):
    k = F.col("conv_id")
    rounds = adapters.table(spark, sf, "conversations").select(k.alias("generation_id"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("task_id"), (F.col("turn") + 1).alias("round")).distinct()
    given = spark.createDataFrame([("k0", 1, "plot"), ("k0", 2, "tone"), ("k1", 1, "pace"), ("k1", 3, "voice")], "task_id string, round long, focus string")
    return turns.feedback(given, rounds).select("generation_id", "round", "focus")


@query
def evaluator_prices(spark, sf):
    prices = spark.createDataFrame([("judge-0", 1.0, 5.0), ("judge-1", 0.5, 2.0)], "evaluator_model string, price_in double, price_out double")
    e = adapters.table(spark, sf, "lineitem").select(F.concat(F.lit("judge-"), (F.col("l_linenumber") % 3).cast("string")).alias("evaluator_model"), (F.col("l_orderkey") % 5000).alias("prompt_tokens"), (F.col("l_partkey") % 700).alias("completion_tokens"))
    c = generate.evaluator_costs(e, prices, K.DEFAULT_PRICE)
    return rounded(c.groupBy("evaluator_model").agg(F.count(F.lit(1)).alias("n"), F.sum("evaluation_cost").alias("cost")), "cost", digits=4)


@query
def display_names(spark, sf):
    return adapters.models(spark, sf).select("model", names.display_name(F.regexp_replace("model", "/model-", "/gpt-")).alias("name"), names.company(F.col("model")).alias("company"))


@query
def company_titles(spark, sf):
    """Companies that no list names, with digits, underscores and full stops inside."""
    company = F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("_"))), F.lit("labs."), F.col("s_nationkey").cast("string"), F.lit("x_y"))
    return adapters.table(spark, sf, "supplier").select("s_suppkey", names.company_name(F.concat(company, F.lit("/m"))).alias("name"))


@query
def mixed_score_maps(spark, sf):
    """Multi-turn judge files whose score maps hold text, booleans, nulls and nested values beside numbers."""
    s = lambda c: F.col(c).cast("string")
    scores = F.concat(F.lit('{"quality":'), s("l_quantity"), F.lit(',"note":"'), "l_returnflag", F.lit('","passed":'), s("open"), F.lit(',"none":null,"deep":{"x":'), s("l_tax"), F.lit('},"share":'), s("l_discount"), F.lit("}"))
    text = F.concat(F.lit('{"task_id":"'), s("l_orderkey"), F.lit("_"), s("l_linenumber"), F.lit('","model":"a/b","process_scores":'), scores, F.lit(',"output_scores":{"kept":'), s("open"), F.lit(',"why":"'), "l_returnflag", F.lit('"}}'))
    docs = adapters.table(spark, sf, "lineitem").withColumn("open", F.col("l_linestatus") == "O").select(text.alias("json"))
    e = ingest.evaluations(docs).select("task_id", judge.map_mean(F.col("process_scores")).alias("process"), judge.map_mean(F.col("output_scores")).alias("output"))
    return rounded(e, "process", "output")


@query
def summary_rows(spark, sf):
    """The summary as rows: the ranking, and the best model of each task type."""
    cells = _cells(spark, sf)
    summary = agg.summary(adapters.evaluations(spark, sf), adapters.generations(spark, sf))
    return rounded(report.summary_rows(summary, agg.model_scores(cells, "task_type")), "score_pct", "cost")


@query
def file_names(spark, sf):
    return adapters.generations(spark, sf).select("sample", names.file_stem(F.col("task_id"), F.col("model"), F.col("sample")).alias("stem"))


@query
def evaluation_type_report(spark, sf):
    e = adapters.evaluations(spark, sf)
    return rounded(agg.evaluation_report(e.where(ledger.succeeded(e)), "task_type").select("task_type", "successful", "avg_score"), "avg_score")


@query
def chart_points(spark, sf):
    p = ranking.cost_score_points(_summary(spark, sf))
    return rounded(p.select("model", "company", "score_pct", "generation_cost", "total_tokens", "marker", "on_frontier"), "score_pct", "generation_cost", "marker")


@query
def radar(spark, sf):
    """Pass rates of the first four models by task type."""
    r = _rates(spark, sf).where("scope = 'model_task_type'")
    few = r.select("model").distinct().orderBy("model").limit(4)
    return rounded(r.join(few, "model", "left_semi").select("model", "task_type", "rate"), "rate")


@query
def find_generation(spark, sf):
    return ledger.find(adapters.generations(spark, sf), sample=7).select("task_id", "model", "sample")


@query
def batch_upsert(spark, sf):
    """Repeated keys inside one batch of evaluations: the one that was recorded last stays."""
    e = adapters.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), F.col("l_shipdate").alias("recorded"))
    return ledger.latest(e, ("l_orderkey", "l_linenumber"), F.desc("recorded"), F.desc("price")).select("l_orderkey", "l_linenumber", "price")


#: Names under which the whole lists and all files were registered beside shorter ones; now the same queries.
_found |= {"slop_score_full": slop_score, "programmatic_score_full": programmatic_score, "all_file_names": file_names}
