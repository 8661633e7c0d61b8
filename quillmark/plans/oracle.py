"""DuckDB SQL of the registered queries; column names and rounding match ``catalog``."""

from __future__ import annotations

from ..functions import constants as K
from ..sources.adapters import COMPANIES, THEORIES


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


TYPES, NAMES = _list(K.TASK_TYPES), _list(COMPANIES)


def _type(i: str) -> str:
    return f"{TYPES}[({i}) % 9 + 1]"


def _task(i: str) -> str:
    return f"{_type(i)} || '_' || lpad(CAST(({i}) AS VARCHAR), 3, '0')"


def _model(k: str) -> str:
    return f"{NAMES}[(({k}) % 25) % 5 + 1] || '/model-' || lpad(CAST(({k}) % 25 AS VARCHAR), 2, '0')"


AGENTIC = "(starts_with(task_type, 'agentic_') OR task_type = 'critique_improvement')"
EVAL = f"""ev AS (SELECT *, {AGENTIC} AS a FROM (SELECT {_task("l_partkey % 34")} AS task_id, {_type("l_partkey % 34")} AS task_type, {_model("l_suppkey")} AS model,
  'judge-' || CAST(l_linenumber % 3 AS VARCHAR) AS evaluator_model, l_orderkey AS sample, l_quantity / 50 AS final_score, l_extendedprice / 1e6 AS evaluation_cost, l_returnflag <> 'R' AS success,
  1 - l_discount * 10 AS w, 1 - l_discount * 5 AS p, abs(l_tax) * 12.5 AS j FROM lineitem))"""
GEN = f"""gen AS (SELECT {_task("o_orderkey % 34")} AS task_id, {_type("o_orderkey % 34")} AS task_type, {_model("o_custkey")} AS model, o_orderkey AS sample, o_totalprice / 1e5 AS generation_cost,
  o_orderkey % 900 + 100 AS prompt_tokens, o_custkey % 3000 + 500 AS completion_tokens, o_orderkey % 700 AS reasoning_tokens, o_orderstatus <> 'F' AS success FROM orders)"""
TASK = f"""tk AS (SELECT {_task("i")} AS task_id, {_type("i")} AS task_type, {_list(THEORIES)}[i % 5 + 1] AS theory, i * 10 + 200 AS word_count_min, i * 10 + 400 AS word_count_max
  FROM (SELECT DISTINCT p_partkey % 34 AS i FROM part))"""
MODEL = f"md AS (SELECT DISTINCT {_model('s_suppkey')} AS model FROM supplier)"
WANTED = f"wd AS (SELECT DISTINCT {_model('s_suppkey')} AS model FROM supplier UNION ALL SELECT 'acme-labs/model-new')"
JUDGES = "jd AS (SELECT DISTINCT evaluator_model FROM ev UNION ALL SELECT 'judge-new')"
CELL = "cell AS (SELECT model, task_id, task_type, median(final_score) AS score, count(*) AS evaluations FROM ev WHERE success GROUP BY ALL)"
BREAK = """brk AS (SELECT model, task_id, task_type, median(CASE WHEN NOT a THEN w END) AS word_count, median(CASE WHEN NOT a THEN p END) AS programmatic,
  CASE WHEN bool_or(a) THEN median((j + final_score) / 2) ELSE median(j) END AS llm_judge, CASE WHEN bool_or(a) THEN median((w + p) / 2) END AS process,
  CASE WHEN bool_or(a) THEN median((j + final_score) / 2) END AS output FROM ev WHERE success GROUP BY model, task_id, task_type)"""
MSCORE = "ms AS (SELECT model, avg(score) AS avg_score, count(score) AS total FROM cell GROUP BY model)"
COST = """cost AS (SELECT model, sum(generation_cost) AS generation_cost, count(*) AS generations, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, CAST(sum(completion_tokens) - sum(reasoning_tokens) AS BIGINT) AS output_tokens, sum(generation_cost) / count(*) AS avg_cost_per_task FROM gen WHERE success GROUP BY model)"""
SUM = """sm AS (SELECT model, avg_score, total, coalesce(generation_cost, 0) AS generation_cost, coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens FROM ms LEFT JOIN cost USING (model))"""
TCOST = "tc AS (SELECT task_id, sum(generation_cost) AS total_cost, avg(generation_cost) AS avg_cost FROM gen WHERE success GROUP BY task_id)"
STATS = """ts AS (SELECT c.task_id, coalesce(any_value(tk.task_type), any_value(c.task_type)) AS task_type, coalesce(any_value(tk.theory), 'Unknown') AS theory, count(score) AS models_evaluated,
  CAST(sum(evaluations) AS BIGINT) AS evaluations_count, avg(score) AS avg_score, min(score) AS min_score, max(score) AS max_score, max(score) - min(score) AS spread, coalesce(stddev_samp(score), 0) AS stdev,
  arg_max(model, (score, -mi)) AS best_model, arg_min(model, (score, mi)) AS worst_model, coalesce(any_value(total_cost), 0) AS total_cost, coalesce(any_value(avg_cost), 0) AS avg_cost
  FROM (SELECT *, dense_rank() OVER (ORDER BY model) AS mi FROM cell) c LEFT JOIN tk ON tk.task_id = c.task_id LEFT JOIN tc ON tc.task_id = c.task_id GROUP BY c.task_id)"""
FLAGS = "fl AS (SELECT source AS model, lang AS task_type, CAST(coalesce(quality = 1, false) AS INTEGER) AS p FROM documents LEFT JOIN labels USING (doc_id))"
RATES = """rt AS (SELECT model, task_type, CASE grouping(model, task_type) WHEN 0 THEN 'model_task_type' WHEN 1 THEN 'model' WHEN 2 THEN 'task_type' ELSE 'overall' END AS scope, count(*) AS n, CAST(sum(p) AS BIGINT) AS passed,
  avg(p) AS rate, var_pop(p) AS variance, stddev_pop(p) AS std FROM fl GROUP BY GROUPING SETS ((model), (task_type), (model, task_type), ()))"""
TURNS = "tn AS (SELECT conv_id AS generation_id, turn AS turn_idx, role, CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'question' ELSE 'generation' END AS turn_type, text AS content FROM conversations)"
#: All characters that count as white space.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = f"list_filter(string_split_regex(text, '[{SPACE}]+'), lambda x: x <> '')"
TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+'))"
NAMED = "CASE split_part(model, '/', 1) WHEN 'anthropic' THEN 'Anthropic' WHEN 'openai' THEN 'OpenAI' WHEN 'qwen' THEN 'Alibaba' WHEN 'z-ai' THEN 'Z-Ai' ELSE 'Acme-Labs' END"
CHARTED = "CASE split_part(model, '/', 1) WHEN 'anthropic' THEN 'Anthropic' WHEN 'openai' THEN 'OpenAI' WHEN 'qwen' THEN 'Alibaba' WHEN 'z-ai' THEN 'Z-AI' ELSE 'Acme-Labs' END"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes)


def _round(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


BASE = (EVAL, CELL)
SUMMARY = (EVAL, CELL, MSCORE, GEN, COST, SUM)
TASKS = (EVAL, CELL, GEN, TASK, TCOST, STATS)
RANGE = "w, 300 AS lo, 500 AS hi"
DEV = "CAST(greatest(lo - n, n - hi, 0) AS DOUBLE)"
CONTENT = f"NOT list_contains({_list(K.STOP_WORDS)}, word) AND length(word) > 2"


def _matrix(source: str, row: str, column: str, value: str, columns: list[str], fill: str = "{}") -> str:
    cells = ", ".join(fill.format(f"max(CASE WHEN {column} = '{c}' THEN {value} END)") + f' AS "{c}"' for c in columns)
    return f"SELECT {row}, {cells} FROM {source} GROUP BY {row}"




def _slop(words: dict[str, float], phrases: dict[str, float]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    weight = "CASE word " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in words.items()) + " ELSE 0 END"
    phrase = " + ".join(f"((length(low) - length(replace(low, {quoted(p)}, ''))) // {len(p)}) * {v}" for p, v in phrases.items())
    return f"""sl AS (SELECT doc_id, CASE WHEN len(t) < 20 THEN 0.8 ELSE greatest(0, 1 - (list_sum([{weight} FOR word IN t]) + {phrase}) / len(t) * 100 * 0.05) END AS slop_score
 FROM (SELECT doc_id, lower(text) AS low, {TOKENS} AS t FROM documents))"""


OWN_SLOP = _slop({"the": 2.0, "of": 1.0, "and": 1.0, "la": 2.0, "der": 1.0, "de": 1.0}, {"of the": 2.0, "the th": 1.0})
SLOP = _slop(K.OVERUSED_WORDS, K.OVERUSED_PHRASES)
TOK = f"tok AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos, len(t) AS n FROM (SELECT doc_id, {TOKENS} AS t FROM documents))"
REP = f"""per AS (SELECT doc_id, word, count(*) AS n, {CONTENT} AS c FROM tok GROUP BY doc_id, word),
tot AS (SELECT doc_id, sum(n) AS total, sum(CASE WHEN c THEN n END) AS content, count(CASE WHEN c THEN 1 END) AS uniq FROM per GROUP BY doc_id),
pen AS (SELECT doc_id, sum(greatest(0, (n - greatest(3.0, 2.0 * content / nullif(uniq, 0))) * 0.02)) AS x FROM per JOIN tot USING (doc_id) WHERE c AND n > 3 GROUP BY doc_id),
big AS (SELECT doc_id, word, nxt, count(*) AS n FROM (SELECT doc_id, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL GROUP BY ALL HAVING count(*) > 3),
bp AS (SELECT doc_id, sum((n - 3) * 0.03) AS y FROM big GROUP BY doc_id),
rep AS (SELECT doc_id, CASE WHEN coalesce(total, 0) < 20 OR coalesce(content, 0) < 10 THEN 0.7 ELSE 1 - least(0.5, coalesce(x, 0) + coalesce(y, 0)) END AS repetition_score
 FROM documents LEFT JOIN tot USING (doc_id) LEFT JOIN pen USING (doc_id) LEFT JOIN bp USING (doc_id))"""
WC = f"wc AS (SELECT doc_id, len({WORDS}) AS n, 300 AS lo, 500 AS hi FROM documents)"
GAUSS = f"CASE WHEN {DEV} = 0 THEN 1.0 ELSE exp(-({DEV} * {DEV}) / (2 * pow(greatest((hi - lo) * 0.8, 50), 2))) END"
PAIRS = """mo AS (SELECT model AS g, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM cell GROUP BY model HAVING count(*) >= 2),
pr AS (SELECT a.g AS model_a, b.g AS model_b, a.n AS n_a, b.n AS n_b, a.m AS mean_a, b.m AS mean_b, a.m - b.m AS difference, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled FROM mo a JOIN mo b ON a.g < b.g)"""
JUDGE_KEYS = {k: f"(doc_id * {17 + 3 * i} % 11) / 10.0" for i, k in enumerate(K.JUDGE_WEIGHTS["beat_interpolation"])}
_JUDGE = " + ".join(f"{w} * CASE doc_id % {5 + i} WHEN 0 THEN {d} WHEN 1 THEN {'1.0' if i % 2 else d} ELSE {JUDGE_KEYS[k]} END" for i, (k, (w, d)) in enumerate(K.JUDGE_WEIGHTS["beat_interpolation"].items()))
#: Weights and defaults of each kind of judge score, in the order of its keys.
JUDGED = {
    "beat_interpolation": [(0.25, 0.5), (0.25, 0.5), (0.15, 1.0), (0.10, 0.5), (0.15, 0.5), (0.10, 0.5)],
    "beat_revision/no_flaw": [(0.40, 0.0), (0.30, 0.0), (0.15, 0.5), (0.15, 0.5)],
    "beat_revision": [(0.20, 0.5), (0.20, 0.5), (0.20, 0.5), (0.10, 0.5), (0.10, 1.0), (0.10, 0.5), (0.10, 0.5)],
    "constrained_continuation": [(0.20, 0.5), (0.30, 0.5), (0.25, 0.5), (0.15, 0.5), (0.10, 0.5)],
    "theory_conversion": [(0.35, 0.5), (0.30, 0.5), (0.20, 0.5), (0.15, 0.5)],
    "multi_beat_synthesis": [(0.40, 0.5), (0.35, 0.5), (0.15, 0.5), (0.10, 0.5)],
}
PROCESS_WEIGHTS = {"constraint_discovery": 0.40, "planning_execution": 0.35, "iterative_revision": 0.30, "critique_improvement": 0.35}
_SIX = "[" + ", ".join(f"CASE WHEN doc_id % {3 + i} <> 0 THEN (doc_id * {i + 2} % 11) / 10.0 ELSE 0.5 END" for i in range(6)) + "]"


def _judged(kind: str) -> str:
    total = " + ".join(f"{w} * CASE WHEN doc_id % {5 + i} = 0 THEN {d} ELSE (doc_id * {17 + 3 * i} % 11) / 10.0 END" for i, (w, d) in enumerate(JUDGED[kind]))
    return f"SELECT doc_id, '{kind}' AS kind, round({total}, 6) AS judge FROM documents"


def _mod(n: int, m: int) -> str:
    return f"(doc_id % {n} <> {m})"


#: Flags of the pass rules: the i-th criterion holds unless doc_id leaves 1 on division by i + 2.
PASSES = f"""SELECT doc_id, CASE (doc_id // 7) % 9 WHEN 0 THEN {' AND '.join(_mod(i + 2, 1) for i in range(5))}
  WHEN 1 THEN {_mod(7, 1)} AND {_mod(8, 1)} AND CAST({_mod(9, 1)} AS INTEGER) + CAST({_mod(3, 1)} AS INTEGER) + CAST({_mod(10, 1)} AS INTEGER) >= 3
  WHEN 2 THEN doc_id % 2 = 0 WHEN 3 THEN {_mod(11, 1)} AND {_mod(12, 1)} AND (doc_id % 10) / 10.0 >= 0.7 WHEN 4 THEN doc_id % 3 = 0 AND doc_id % 5 <> 0 ELSE false END AS pass FROM documents"""

SQL: dict[str, str] = {
    "leaderboard": f"{_with(*SUMMARY)} SELECT row_number() OVER (ORDER BY round(coalesce(avg_score, 0), 12) DESC, model) AS rank, model, split_part(model, '/', -1) AS model_short, {NAMED} AS company, {_round('avg_score', 'generation_cost')}, total FROM sm",
    "cell_scores": f"{_with(*BASE)} SELECT model, task_id, task_type, {_round('score')}, evaluations FROM cell",
    "cell_breakdown": f"{_with(EVAL, BREAK)} SELECT model, task_id, {_round('word_count', 'programmatic', 'llm_judge', 'process', 'output')} FROM brk",
    "model_components": f"{_with(EVAL, BREAK)} SELECT model, round(avg(word_count), 6) AS avg_word_count, round(avg(programmatic), 6) AS avg_programmatic, round(avg(llm_judge), 6) AS avg_llm_judge FROM brk GROUP BY model",
    "model_task_type_scores": f"{_with(*BASE)} SELECT model, task_type, round(avg(score), 6) AS avg_score, count(score) AS total FROM cell GROUP BY ALL",
    "model_task_type_components": f"{_with(EVAL, BREAK)} SELECT model, task_type, round(avg(word_count), 9) AS avg_word_count, round(avg(programmatic), 9) AS avg_programmatic, round(avg(llm_judge), 9) AS avg_llm_judge FROM brk GROUP BY model, task_type",
    "model_costs": f"{_with(GEN, COST)} SELECT model, {_round('generation_cost', 'avg_cost_per_task')}, generations, prompt_tokens, completion_tokens, reasoning_tokens, output_tokens FROM cost",
    "value_ranking": f"{_with(*SUMMARY)} SELECT row_number() OVER (ORDER BY round(avg_score * avg_score * 100 / generation_cost, 12) DESC, model) AS rank, model, round(avg_score * avg_score * 100 / generation_cost, 6) AS value FROM sm WHERE generation_cost > 0",
    "cost_efficiency": f"{_with(GEN, COST)} SELECT model, output_tokens, round(CASE WHEN completion_tokens > 0 THEN reasoning_tokens * 100.0 / completion_tokens ELSE 0 END, 6) AS reasoning_pct, round(CASE WHEN output_tokens > 0 THEN generation_cost / output_tokens * 1000 ELSE 0 END, 6) AS cost_per_1k_output FROM cost",
    "score_matrix": f"{_with(*BASE)} {_matrix('(SELECT model, task_type, round(avg(score), 6) AS s FROM cell GROUP BY ALL)', 'model', 'task_type', 's', K.TASK_TYPES)}",
    "heat_map": f"{_with(*BASE)} {_matrix('(SELECT model, task_type, avg(score) AS s FROM cell GROUP BY ALL)', 'model', 'task_type', 's', K.TASK_TYPES, 'round(coalesce({}, 0) * 100, 6)')}",
    "task_model_matrix": f"{_with(*BASE)} {_matrix('cell', 'task_id', 'model', 'round(score, 6)', [f'{COMPANIES[m % 5]}/model-{m:02d}' for m in range(25)])}",
    "task_stats": f"{_with(*TASKS)} SELECT task_id, task_type, theory, models_evaluated, evaluations_count, {_round('avg_score', 'min_score', 'max_score', 'spread', 'stdev', 'total_cost', 'avg_cost')}, best_model, worst_model FROM ts",
    "task_type_discrimination": f"""{_with(*TASKS)} SELECT task_type, count(*) AS tasks, round(avg(avg_score), 6) AS avg_score, round(avg(spread), 6) AS avg_spread, round(max(spread), 6) AS max_spread,
      CASE WHEN avg(spread) >= 0.20 THEN 'Excellent' WHEN avg(spread) >= 0.15 THEN 'Good' WHEN avg(spread) >= 0.10 THEN 'Moderate' ELSE 'Low' END AS rating FROM ts GROUP BY task_type""",
    "task_type_costs": f"{_with(*TASKS)} SELECT task_type, round(sum(total_cost), 6) AS total_cost, round(avg(avg_cost), 6) AS avg_cost FROM ts GROUP BY task_type",
    **{
        name: f"{_with(*TASKS)} SELECT row_number() OVER (ORDER BY {order}, task_id) AS rank, task_id, {_round('avg_score', 'spread')}, best_model, worst_model FROM ts ORDER BY {order}, task_id LIMIT 10"
        for name, order in {"top_discriminative": "round(ts.spread, 12) DESC", "hardest": "round(ts.avg_score, 12)", "easiest": "round(ts.avg_score, 12) DESC"}.items()
    },
    "task_details": f"{_with(*TASKS)} SELECT task_type, task_id, {_round('spread')}, row_number() OVER (PARTITION BY task_type ORDER BY round(spread, 12) DESC, task_id) AS place FROM ts",
    "best_by_type": f"""{_with(*BASE, MSCORE)}, r AS (SELECT model, row_number() OVER (ORDER BY round(avg_score, 12) DESC, model) AS rank FROM ms), t AS (SELECT model, task_type, avg(score) AS s FROM cell GROUP BY ALL)
      SELECT task_type, model, round(s, 6) AS avg_score FROM t JOIN r USING (model) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY round(s, 12) DESC, rank) = 1""",
    "pareto_frontier": f"""{_with(*SUMMARY)} SELECT model, {_round('generation_cost', 'avg_score')}, coalesce(round(avg_score, 12) > max(round(avg_score, 12)) OVER (ORDER BY round(generation_cost, 12), round(avg_score, 12) DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS on_frontier FROM sm""",
    "marker_sizes": f"{_with(*SUMMARY)} SELECT model, round(CASE WHEN max(t) OVER () = min(t) OVER () THEN 100 ELSE 50 + (t - min(t) OVER ()) * 100.0 / (max(t) OVER () - min(t) OVER ()) END, 6) AS marker FROM (SELECT model, prompt_tokens + completion_tokens AS t FROM sm)",
    "contributions": f"{_with(EVAL, BREAK)} SELECT model, round(coalesce(avg(programmatic), 0) * 50, 6) AS programmatic_part, round(coalesce(avg(llm_judge), 0) * 50, 6) AS llm_judge_part FROM brk GROUP BY model",
    "missing_generations": f"{_with(GEN, TASK, WANTED)} SELECT task_id, model FROM tk CROSS JOIN wd WHERE NOT EXISTS (SELECT 1 FROM gen WHERE success AND gen.task_id = tk.task_id AND gen.model = wd.model)",
    "missing_evaluations": f"""{_with(GEN, EVAL, JUDGES)} SELECT g.task_id, g.model, g.sample, v.evaluator_model FROM gen g CROSS JOIN jd v WHERE g.success AND NOT EXISTS
      (SELECT 1 FROM ev WHERE ev.success AND ev.task_id = g.task_id AND ev.model = g.model AND ev.evaluator_model = v.evaluator_model)""",
    "work_estimate": f"""{_with(GEN, EVAL, TASK, WANTED, JUDGES)}, a AS (SELECT count(*) AS n FROM (SELECT DISTINCT task_id FROM tk) t CROSS JOIN wd WHERE NOT EXISTS (SELECT 1 FROM gen WHERE success AND gen.task_id = t.task_id AND gen.model = wd.model)),
      b AS (SELECT count(*) AS n FROM gen g CROSS JOIN jd v WHERE g.success AND g.model IN (SELECT model FROM wd) AND NOT EXISTS
      (SELECT 1 FROM ev WHERE ev.success AND ev.task_id = g.task_id AND ev.model = g.model AND ev.evaluator_model = v.evaluator_model))
      SELECT a.n AS generations, b.n AS evaluations, round(a.n * 0.001 + b.n * 0.0007, 6) AS estimated_cost FROM a, b""",
    "forced_generations": f"{_with(TASK, WANTED)} SELECT task_id, model FROM tk CROSS JOIN wd",
    "planned_after_purge": f"{_with(GEN, MODEL)} SELECT model, count(*) AS kept, count(*) FILTER (NOT success) AS failed FROM gen WHERE success OR NOT (starts_with(model, 'openai/') AND model IN (SELECT model FROM md)) GROUP BY model",
    "purge_counts": f"{_with(GEN, EVAL)} SELECT 'generations' AS ledger, count(*) AS removed FROM gen WHERE NOT success AND model = 'anthropic/model-00' UNION ALL SELECT 'evaluations', count(*) FROM ev WHERE NOT success",
    "purge_failed_evaluations": f"{_with(EVAL)} SELECT evaluator_model, count(*) AS kept, CAST(sum(sample) AS BIGINT) AS samples FROM ev WHERE success GROUP BY evaluator_model",
    "upsert_latest": """WITH b AS (SELECT * FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
      c AS (SELECT * FROM events WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
      SELECT user_id, event_type, event_id FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = c.user_id AND b.event_type = c.event_type) UNION ALL SELECT user_id, event_type, event_id FROM b""",
    "purge_failed": f"{_with(GEN)} SELECT task_id, model, sample FROM gen WHERE success OR model <> 'anthropic/model-00'",
    "ledger_totals": f"{_with(GEN, EVAL)} SELECT round((SELECT sum(generation_cost) FROM gen), 4) AS generation_cost, (SELECT count(*) FROM gen) AS generations, round((SELECT sum(evaluation_cost) FROM ev), 4) AS evaluation_cost, (SELECT count(*) FROM ev) AS evaluations, round((SELECT sum(generation_cost) FROM gen) + (SELECT sum(evaluation_cost) FROM ev), 4) AS total_cost",
    "status": f"{_with(GEN, EVAL)} SELECT (SELECT string_agg(DISTINCT model, ',' ORDER BY model) FROM gen) AS models, (SELECT count(DISTINCT task_id) FROM gen) AS tasks, (SELECT count(*) FROM gen) AS generations, (SELECT string_agg(DISTINCT evaluator_model, ',' ORDER BY evaluator_model) FROM ev WHERE success) AS evaluators, (SELECT count(*) FROM ev) AS evaluations",
    "generation_cost_report": f"{_with(GEN)} SELECT model, count(*) AS total, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures, round(sum(generation_cost), 4) AS cost, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM gen GROUP BY model",
    "generation_type_report": f"{_with(GEN)} SELECT task_type, count(*) AS total, count(*) FILTER (success) AS successes, round(sum(generation_cost), 4) AS cost FROM gen GROUP BY task_type",
    "evaluation_report": f"{_with(EVAL)} SELECT model, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS errors, round(avg(final_score) FILTER (success), 6) AS avg_score, round(sum(evaluation_cost), 4) AS cost FROM ev GROUP BY model",
    "pass_rates_grouping_sets": f"{_with(FLAGS, RATES)} SELECT scope, model, task_type, n, passed, {_round('rate', 'variance', 'std')} FROM rt",
    "pass_rate_matrix": f"{_with(FLAGS, RATES)} {_matrix(chr(40) + 'SELECT * FROM rt WHERE scope = ' + chr(39) + 'model_task_type' + chr(39) + chr(41), 'model', 'task_type', 'round(rate, 6)', ['de', 'en', 'es', 'fr'])}",
    "extreme_types": f"""{_with(FLAGS, RATES)}, o AS (SELECT task_type, rate, row_number() OVER (ORDER BY rate, task_type) AS lo, row_number() OVER (ORDER BY rate DESC, task_type DESC) AS hi FROM rt WHERE scope = 'task_type')
      SELECT task_type, {_round('rate')}, 'weakest' AS "end" FROM o WHERE lo <= 2 UNION ALL SELECT task_type, {_round('rate')}, 'strongest' FROM o WHERE hi <= 2""",
    "model_gaps": f"""{_with(FLAGS, RATES)}, m AS (SELECT *, dense_rank() OVER (ORDER BY model) AS mi FROM rt WHERE scope = 'model_task_type')
      SELECT task_type, count(*) AS models, round(max(rate) - min(rate), 6) AS gap, arg_max(model, (rate, -mi)) AS best_model, arg_min(model, (rate, mi)) AS worst_model FROM m GROUP BY task_type HAVING count(*) >= 2 AND max(rate) - min(rate) > 0.15""",
    "pairwise_ttest": f"{_with(*BASE)}, {PAIRS} SELECT model_a, model_b, n_a, n_b, {_round('difference')}, round(CASE WHEN pooled > 0 THEN difference / sqrt(pooled * (1.0 / n_a + 1.0 / n_b)) END, 6) AS t FROM pr",
    "cohens_d": f"""{_with(*BASE)}, {PAIRS}, d AS (SELECT *, CASE WHEN pooled > 0 THEN difference / sqrt(pooled) ELSE 0 END AS cohens_d FROM pr)
      SELECT model_a, model_b, {_round('cohens_d')}, CASE WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d""",
    "word_count": f"SELECT doc_id, len({WORDS}) AS words FROM documents",
    "word_count_scores": f"WITH {WC} SELECT doc_id, round({GAUSS}, 6) AS gaussian, round(1 - tanh(0.02 * {DEV}), 6) AS tanh, round(2 / (1 + exp(least(0.03 * {DEV}, 700))), 6) AS sigmoid FROM wc",
    "tokens": f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, t[1] AS first_token FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
    "sentences": f"SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(regexp_replace(x, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')), lambda x: x <> '')) AS sentences FROM documents",
    "repetition_score": f"WITH {TOK}, {REP} SELECT doc_id, round(repetition_score, 6) AS repetition_score FROM rep",
    "slop_score_own_lists": f"WITH {OWN_SLOP} SELECT doc_id, round(slop_score, 6) AS slop_score FROM sl",
    "slop_score": f"WITH {SLOP} SELECT doc_id, round(slop_score, 6) AS slop_score FROM sl",
    "programmatic_score": f"WITH {TOK}, {REP}, {SLOP}, {WC} SELECT doc_id, round(0.40 * ({GAUSS}) + 0.35 * repetition_score + 0.25 * slop_score, 6) AS programmatic FROM wc JOIN rep USING (doc_id) JOIN sl USING (doc_id)",
    "judge_score": f"SELECT doc_id, round({_JUDGE}, 6) AS judge FROM documents",
    "final_score": f"WITH {WC} SELECT doc_id, round(0.5 * ({GAUSS}) + 0.5 * ({_JUDGE}), 6) AS final FROM wc",
    "judge_scores": " UNION ALL ".join(map(_judged, JUDGED)),
    "agentic_kinds": f"WITH v AS (SELECT doc_id, {_SIX} AS x FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, round((x[1] + x[2] + x[3]) / 3, 6) AS process, round((x[4] + x[5] + x[6]) / 3, 6) AS output, round((x[1] + x[2] + x[3]) / 3 * {w} + (x[4] + x[5] + x[6]) / 3 * (1 - {w}), 6) AS final FROM v" for k, w in PROCESS_WEIGHTS.items()),
    "schema_violations": """SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END END AS violations FROM part""",
    "evaluation_schema": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END
      + CASE WHEN p_partkey % 7 = 0 THEN CASE p_partkey % 5 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 0 END ELSE 0 END AS violations FROM part""",
    "pass_by_type": PASSES,
    "question_answer_pairs": f"""{_with(TURNS)} SELECT generation_id, turn_idx, md5(content) AS question_md5, md5(coalesce(nxt, 'N/A')) AS answer_md5 FROM (SELECT *, lead(content) OVER (PARTITION BY generation_id ORDER BY turn_idx) AS nxt FROM tn) WHERE turn_type = 'question'""",
    "turn_metrics": f"{_with(TURNS)} SELECT generation_id, count(*) AS total_turns, count(*) FILTER (turn_type = 'question') AS questions_asked, count(*) FILTER (turn_type = 'answer' AND upper(trim(content)) = 'YES') AS constraints_discovered, greatest(count(*) FILTER (turn_type = 'generation') - 1, 0) AS revision_count FROM tn GROUP BY generation_id",
    "last_generation": f"{_with(TURNS)} SELECT generation_id, max(turn_idx) AS turn_idx, md5(arg_max(content, turn_idx)) AS output_md5 FROM tn WHERE role = 'assistant' AND turn_type = 'generation' GROUP BY generation_id",
    "first_question": f"{_with(TURNS)}, f AS (SELECT generation_id, arg_min(content, turn_idx) AS c FROM tn WHERE turn_type = 'question' GROUP BY generation_id) SELECT generation_id, CASE WHEN length(c) > 2000 THEN c[1:2000] || '...' ELSE c END AS plan FROM f",
    "revision_trajectory": f"{_with(TURNS)} SELECT generation_id, row_number() OVER (PARTITION BY generation_id ORDER BY turn_idx) AS revision, content[1:500] AS excerpt FROM tn WHERE turn_type = 'generation'",
    "critique_trajectory": f"{_with(TURNS)} SELECT generation_id, row_number() OVER (PARTITION BY generation_id ORDER BY turn_idx) AS revision, content[1:400] AS excerpt FROM tn WHERE turn_type = 'generation' QUALIFY revision <= 4",
    "token_rollup": f"{_with(TURNS)} SELECT generation_id, CAST(sum(turn_idx * 10 + 5) AS BIGINT) AS prompt_tokens, CAST(sum(length(content)) AS BIGINT) AS completion_tokens, round(sum(turn_idx * 0.25), 6) AS cost FROM tn GROUP BY generation_id",
    "keyword_match": f"""{_with(TURNS)} SELECT generation_id, turn_idx, CASE WHEN contains(lower(content), 'the') OR contains(lower(content), 'der') THEN 'YES' WHEN contains(lower(content), 'la') THEN 'MAYBE' ELSE 'NO' END AS answer FROM tn WHERE turn_type = 'question'""",
    "oracle_answers": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'NO' WHEN 1 THEN 'B' WHEN 2 THEN 'YES' WHEN 3 THEN 'NO' WHEN 4 THEN 'YES' ELSE 'A' END AS answer FROM events""",
    "json_extract": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""",
    "safe_float": """SELECT event_id, CASE event_id % 10 WHEN 0 THEN round(value, 6) WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 6 THEN 2.5 WHEN 7 THEN 10.0 WHEN 8 THEN -5.0 ELSE 0.5 END AS v FROM events""",
    "company_rollup": f"{_with(*SUMMARY)} SELECT {NAMED} AS company, count(*) AS models, round(avg(avg_score), 6) AS avg_score, round(sum(generation_cost), 4) AS cost FROM sm GROUP BY 1",
    "token_limits": f"{_with(GEN)} SELECT task_type, any_value(CASE task_type " + " ".join(f"WHEN '{t}' THEN {a}" for t, (a, _) in K.TOKEN_LIMITS.items()) + " END) AS max_tokens, any_value(CASE task_type " + " ".join(f"WHEN '{t}' THEN {b}" for t, (_, b) in K.TOKEN_LIMITS.items()) + " END) AS max_reasoning FROM gen GROUP BY task_type",
    "response_class": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE text END AS o, 1000 AS c, doc_id % 1200 AS re, CASE doc_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN NULL ELSE 'length' END AS f FROM documents)
      SELECT doc_id, CASE WHEN trim(o) = '' AND re > 0 AND re >= 0.9 * c THEN 'reasoning_only' WHEN trim(o) = '' THEN 'content_filtered' WHEN coalesce(f, '') IN ('', 'stop') THEN NULL ELSE 'bad_finish' END AS class FROM r""",
    "error_rates": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY ALL",
    "continuation_pass": "SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END + 2) / 5.0 >= 0.8 AS pass FROM documents",
    "synthesis_pass": "SELECT doc_id, (doc_id % 7 = 0 OR doc_id % 3 = 0) AND CASE WHEN doc_id % 4 = 0 THEN doc_id % 11 <> 0 AND doc_id % 5 <> 0 ELSE (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + 2) / 3.0 >= 0.7 END AS pass FROM documents",
    "word_ranges": f"{_with(TASK)} SELECT task_id, coalesce(CASE WHEN word_count_min % 3 <> 0 THEN word_count_min END, CASE task_type "
    + " ".join(f"WHEN '{t}' THEN {a}" for t, (a, _) in K.WORD_RANGES.items())
    + " ELSE 300 END) AS low, coalesce(CASE WHEN word_count_max % 3 <> 0 THEN word_count_max END, CASE task_type "
    + " ".join(f"WHEN '{t}' THEN {b}" for t, (_, b) in K.WORD_RANGES.items())
    + " ELSE 600 END) AS high FROM tk",
    "beat_budgets": f"{_with(TASK)} SELECT task_id, word_count_min // 3 AS low, word_count_max // 3 AS high FROM tk",
    "words_in_range": f"SELECT doc_id, len({WORDS}) BETWEEN 300 AND 500 AS fits FROM documents",
    "first_tasks": f"{_with(TASK)} SELECT task_id, task_type FROM tk WHERE task_type IN ('beat_revision', 'critique_improvement') ORDER BY list_position({TYPES}, task_type), task_id LIMIT 5",
    "agentic_scores": "WITH v AS (SELECT doc_id, ["
    + ", ".join(f"CASE WHEN doc_id % {3 + i} <> 0 THEN (doc_id * {i + 2} % 11) / 10.0 ELSE 0.5 END" for i in range(6))
    + "] AS x FROM documents) SELECT doc_id, round((x[1] + x[2] + x[3]) / 3, 6) AS process, round((x[4] + x[5] + x[6]) / 3, 6) AS output, round((x[1] + x[2] + x[3]) / 3 * 0.35 + (x[4] + x[5] + x[6]) / 3 * 0.65, 6) AS final FROM v",
    "interpolation_pass": "SELECT doc_id, " + " AND ".join(f"(doc_id % {7 + i} <> 0 AND doc_id % {2 + i} <> 1)" for i in range(5)) + " AS pass FROM documents",
    "revision_pass": "SELECT doc_id, " + " AND ".join(f"(doc_id % {7 + i} <> 0 AND doc_id % {2 + i} <> 1)" for i in range(5)) + " AS pass FROM documents",
    "conversion_pass": "SELECT doc_id, doc_id % 2 = 0 AND (doc_id % 5 <> 0 AND doc_id % 3 = 0) AND coalesce(CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 10) / 10.0 END, 0) >= 0.7 AS pass FROM documents",
    "generation_tasks": f"{_with(GEN, TASK)} SELECT theory, count(*) AS n, count(DISTINCT model) AS models FROM gen JOIN tk USING (task_id) GROUP BY theory",
    "feedback_rounds": """WITH r AS (SELECT DISTINCT conv_id AS generation_id, 'k' || CAST(conv_id % 3 AS VARCHAR) AS task_id, turn + 1 AS round FROM conversations),
      g(task_id, round, focus) AS (VALUES ('k0', 1, 'plot'), ('k0', 2, 'tone'), ('k1', 1, 'pace'), ('k1', 3, 'voice')), j AS (SELECT generation_id, r.round, focus FROM r LEFT JOIN g ON r.task_id = g.task_id AND r.round = g.round)
      SELECT generation_id, round, focus FROM j QUALIFY NOT bool_or(focus IS NULL) OVER (PARTITION BY generation_id ORDER BY round)""",
    "evaluator_prices": """SELECT 'judge-' || CAST(l_linenumber % 3 AS VARCHAR) AS evaluator_model, count(*) AS n, round(sum((l_orderkey % 5000) / 1e6 * CASE l_linenumber % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END
      + (l_partkey % 700) / 1e6 * CASE l_linenumber % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END), 4) AS cost FROM lineitem GROUP BY 1""",
    "display_names": f"{_with(MODEL)} SELECT model, 'GPT-' || split_part(model, '-', -1) AS name, split_part(model, '/', 1) AS company FROM md",
    "p_values": f"""{_with(*BASE).replace('WITH', 'WITH RECURSIVE')}, {PAIRS}, tt AS (SELECT model_a, model_b, n_a + n_b - 2 AS df, CASE WHEN pooled > 0 THEN difference / sqrt(pooled * (1.0 / n_a + 1.0 / n_b)) END AS t FROM pr),
      an AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM tt),
      se(model_a, model_b, df, th, k, term, total) AS (SELECT model_a, model_b, df, th, df % 2, CASE WHEN df % 2 = 0 THEN 1.0 ELSE cos(th) END, CASE WHEN df = 1 THEN 0.0 WHEN df % 2 = 0 THEN 1.0 ELSE cos(th) END FROM an WHERE t IS NOT NULL
        UNION ALL SELECT model_a, model_b, df, th, k + 2, term * (k + 1) / (k + 2) * cos(th) * cos(th), total + term * (k + 1) / (k + 2) * cos(th) * cos(th) FROM se WHERE k + 2 <= df - 2),
      su AS (SELECT model_a, model_b, arg_max(total, k) AS total FROM se GROUP BY ALL),
      pv AS (SELECT model_a, model_b, t, df, 1 - CASE WHEN df % 2 = 0 THEN sin(th) * total ELSE 2 / pi() * (th + sin(th) * total) END AS p FROM an LEFT JOIN su USING (model_a, model_b))
      SELECT model_a, model_b, round(t, 6) AS t, df, round(greatest(p, 0), 6) AS p, coalesce(p < 0.05, false) AS significant FROM pv""",
    "phrase_hits": f"""WITH w AS (SELECT DISTINCT unnest({TOKENS}) AS p FROM benchmark), f AS (SELECT p FROM w WHERE length(p) >= 5),
      c AS (SELECT conv_id, turn, lower(text) AS low FROM conversations), h AS (SELECT conv_id, turn, (length(low) - length(replace(low, p, ''))) // length(p) AS n FROM c JOIN f ON contains(low, p))
      SELECT c.conv_id, c.turn, count(n) AS phrases, CAST(coalesce(sum(n), 0) AS BIGINT) AS hits FROM c LEFT JOIN h ON h.conv_id = c.conv_id AND h.turn = c.turn GROUP BY ALL""",
    "pattern_answers": f"""{_with(TURNS)}, w AS (SELECT DISTINCT unnest({TOKENS}) AS p FROM benchmark), f AS (SELECT p, (row_number() OVER (ORDER BY p) - 1) % 50 AS k FROM w WHERE length(p) >= 5)
      SELECT generation_id, turn_idx, coalesce('C' || lpad(CAST(min(k) AS VARCHAR), 2, '0'), 'NO') AS answer FROM (SELECT * FROM tn WHERE turn_type = 'question') LEFT JOIN f ON contains(lower(content), p) GROUP BY generation_id, turn_idx""",
    "order_schema": """WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) + count(*) FILTER (l_quantity < 1 OR l_quantity > 45) + count(*) FILTER (l_discount >= 0.09) AS bad FROM lineitem GROUP BY l_orderkey)
      SELECT o_orderkey, CAST(bad + (n < 2)::INT + CASE WHEN o_orderstatus = 'F' THEN (NOT o_totalprice > 100000)::INT ELSE (o_totalprice > 100000)::INT END AS INTEGER) AS violations FROM orders JOIN l ON o_orderkey = l_orderkey""",
    "order_ranks": """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank,
      coalesce(o_totalprice > max(o_totalprice) OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS record FROM orders""",
    "conversation_summaries": f"""{_with(TURNS)}, n AS (SELECT *, lead(content) OVER (PARTITION BY generation_id ORDER BY turn_idx) AS nxt FROM tn)
      SELECT generation_id, count(*) AS total_turns, count(*) FILTER (turn_type = 'question') AS questions_asked, greatest(count(*) FILTER (turn_type = 'generation') - 1, 0) AS revision_count, CAST(sum(length(role)) AS BIGINT) AS prompt_tokens,
      CAST(sum(length(content)) AS BIGINT) AS completion_tokens, round(sum(turn_idx * 0.25), 6) AS cost, count(*) FILTER (turn_type = 'question') AS questions, md5(arg_min(coalesce(nxt, 'N/A'), turn_idx) FILTER (turn_type = 'question')) AS first_answer_md5,
      md5(arg_max(content, turn_idx) FILTER (role = 'assistant' AND turn_type = 'generation')) AS output_md5 FROM n GROUP BY generation_id""",
    "kept_evaluation_report": f"{_with(EVAL)}, n AS (SELECT * REPLACE (CASE WHEN evaluator_model = 'judge-1' THEN final_score / 2 ELSE final_score END AS final_score) FROM ev) SELECT model, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS errors, round(avg(final_score) FILTER (success), 6) AS avg_score, round(sum(evaluation_cost), 4) AS cost FROM n GROUP BY model",
    "range_medians": "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice * (1 - l_discount)), 4) AS median, count(*) AS n FROM lineitem GROUP BY ALL",
    "company_titles": """SELECT s_suppkey, array_to_string(list_transform(regexp_extract_all(lower(replace(s_name, '#', '_')) || 'labs.' || CAST(s_nationkey AS VARCHAR) || 'x_y', '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS name FROM supplier""",
    "mixed_score_maps": """SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS task_id, round((l_quantity + CAST(l_linestatus = 'O' AS INTEGER) + l_discount) / 3, 6) AS process, CAST(l_linestatus = 'O' AS DOUBLE) AS output FROM lineitem""",
    "summary_rows": f"""{_with(*SUMMARY)}, r AS (SELECT *, row_number() OVER (ORDER BY round(coalesce(avg_score, 0), 12) DESC, model) AS rank FROM sm), t AS (SELECT model, task_type, avg(score) AS s FROM cell GROUP BY ALL),
      b AS (SELECT task_type, model, s FROM t JOIN r USING (model) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY round(s, 12) DESC, rank) = 1)
      SELECT 'ranking' AS part, CAST(rank AS VARCHAR) AS place, split_part(model, '/', -1) AS name, round(CASE WHEN avg_score <> 0 THEN avg_score * 100 END, 6) AS score_pct, {_round('generation_cost').replace('AS generation_cost', 'AS cost')} FROM r
      UNION ALL SELECT 'best', task_type, split_part(model, '/', -1), round(s * 100, 6), NULL FROM b""",
    "file_names": f"{_with(GEN)} SELECT sample, task_id || '_' || replace(model, '/', '_') || '_' || CAST(sample AS VARCHAR) AS stem FROM gen",
    "evaluation_type_report": f"{_with(EVAL)} SELECT task_type, count(*) AS successful, round(avg(final_score), 6) AS avg_score FROM ev WHERE success GROUP BY task_type",
    "chart_points": f"""{_with(*SUMMARY)}, p AS (SELECT *, prompt_tokens + completion_tokens AS t FROM sm WHERE generation_cost > 0)
      SELECT model, {CHARTED} AS company, round(avg_score * 100, 6) AS score_pct, {_round('generation_cost')}, t AS total_tokens, round(CASE WHEN max(t) OVER () = min(t) OVER () THEN 100 ELSE 50 + (t - min(t) OVER ()) * 100.0 / (max(t) OVER () - min(t) OVER ()) END, 6) AS marker,
      coalesce(round(avg_score, 12) > max(round(avg_score, 12)) OVER (ORDER BY round(generation_cost, 12), round(avg_score, 12) DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS on_frontier FROM p""",
    "radar": f"{_with(FLAGS, RATES)} SELECT model, task_type, {_round('rate')} FROM rt WHERE scope = 'model_task_type' AND model IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 4)",
    "find_generation": f"{_with(GEN)} SELECT task_id, model, sample FROM gen WHERE sample = 7",
    "batch_upsert": "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, round(l_extendedprice, 2) DESC) = 1",
}
SQL |= {"slop_score_full": SQL["slop_score"], "programmatic_score_full": SQL["programmatic_score"], "all_file_names": SQL["file_names"]}
