"""Judge results: safe numbers, JSON extraction, weighted scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"


def safe_float(value: Column, default: float = 0.0) -> Column:
    """A number out of judge text; booleans count 1 and 0, anything else that doesn't parse gives the default.

    The pattern refuses what only Java takes for a number, such as a type suffix ("1d", "0.8f").
    """
    low = F.lower(F.trim(value))
    number = F.when(low.rlike(_NUMBER), F.replace(low, F.lit("_"), F.lit("")).try_cast("double"))
    return F.coalesce(F.when(low == "true", 1.0).when(low == "false", 0.0), number, F.lit(default))


def extract_json(text: Column) -> Column:
    """JSON out of a model's answer as text: the whole string, a fenced block, or from the first to the last brace; else null."""
    tries = [text, F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1), F.regexp_extract(text, r"\{[\s\S]*\}", 0)]
    might = lambda t: t.rlike(r'^\s*[\[{"\-0-9tfn]')  # noqa: E731  the parser is slow to refuse
    return F.coalesce(*[F.when(might(t) & F.try_parse_json(F.when(might(t), t)).isNotNull(), F.trim(t)) for t in tries])


def _get(results: Column, key: str, default: float) -> Column:
    return safe_float(F.try_element_at(results, F.lit(key)), default)


def judge_score(task_type: str, results: Column) -> Column:
    """Weighted judge score of a single-turn type out of map<string,string>; no clamping, empty maps score 0."""
    if task_type not in K.JUDGE_WEIGHTS:
        raise ValueError(f"unknown task type: {task_type}")

    def total(name: str) -> Column:
        return sum((_get(results, f"{k}_score", d) * w for k, (w, d) in K.JUDGE_WEIGHTS[name].items()), F.lit(0.0))

    score = total(task_type)
    if task_type == "beat_revision":
        score = F.when(F.map_contains_key(results, "correct_diagnosis_score"), total("beat_revision/no_flaw")).otherwise(score)
    return F.when(F.coalesce(F.size(results), F.lit(0)) <= 0, 0.0).otherwise(score)


def judge_score_by_type(task_type: Column, results: Column) -> Column:
    """``judge_score`` chosen by row; null for other types."""
    out = F.lit(None).cast("double")
    for t in ("beat_interpolation", "beat_revision", "constrained_continuation", "theory_conversion", "multi_beat_synthesis"):
        out = F.when(task_type == t, judge_score(t, results)).otherwise(out)
    return out


def agentic_result(kind: str, results: Column) -> Column:
    """struct<process map<string,double>, output map<string,double>, final double> of a multi-turn type; each number is read once.

    Missing values count 0.5, an unknown type scores 0.
    """
    none = F.create_map().cast("map<string,double>")
    if kind not in K.AGENTIC_SCORES:
        return F.struct(none.alias("process"), none.alias("output"), F.lit(0.0).alias("final"))
    weight, keys = K.AGENTIC_SCORES[kind]
    named = lambda ks: F.array(*map(F.lit, ks))
    numbers = lambda m, ks: F.transform(F.transform(named(ks), lambda k: F.lower(F.trim(F.try_element_at(m, k)))), lambda low: safe_float(low, 0.5))
    mean = lambda x, ks: sum((x[i] for i in range(len(ks))), F.lit(0.0)) / len(ks)

    def scores(x: Column) -> Column:
        p, o = x["p"], x["o"]
        final = mean(p, keys) * weight + mean(o, K.AGENTIC_OUTPUTS) * (1 - weight)
        return F.struct(F.map_from_arrays(named(keys), p).alias("process"), F.map_from_arrays(named(K.AGENTIC_OUTPUTS), o).alias("output"), final.alias("final"))

    once = lambda value, use: F.transform(F.array(value), use)[0]
    return once(results, lambda m: once(F.struct(numbers(m, keys).alias("p"), numbers(m, K.AGENTIC_OUTPUTS).alias("o")), scores))


def agentic_scores(kind: str, results: Column) -> tuple[Column, Column, Column]:
    """(process map, output map, final) of a multi-turn type, see ``agentic_result``."""
    r = agentic_result(kind, results)
    return r["process"], r["output"], r["final"]


def map_mean(scores: Column) -> Column:
    """Mean of a map's non-null values; null for none."""
    values = F.filter(F.map_values(scores), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))
