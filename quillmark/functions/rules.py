"""Pass rules over judge booleans, and schema checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _true(results: Column, key: str) -> Column:
    return F.coalesce(results[key], F.lit(False))


def interpolation_pass(results: Column, keys: tuple[str, ...]) -> Column:
    """All booleans true; an absent one counts as false."""
    out = F.lit(True)
    for k in keys:
        out = out & _true(results, k)
    return out


def revision_pass(results: Column, required: tuple[str, ...], others: tuple[str, ...], least: int = 3) -> Column:
    """Both required booleans and at least three of the others."""
    return interpolation_pass(results, required) & (sum((_true(results, k).cast("int") for k in others), F.lit(0)) >= least)


def true_share(checks: Column) -> Column:
    """Share of true values of a map; null for an empty or null map."""
    return F.try_divide(F.size(F.filter(F.map_values(checks), lambda x: F.coalesce(x, F.lit(False)))), F.nullif(F.coalesce(F.size(checks), F.lit(0)), F.lit(0)))


def continuation_pass(checks: Column) -> Column:
    return F.coalesce(true_share(checks) >= 0.80, F.lit(False))


def conversion_pass(first: Column, second: Column, accuracy: Column) -> Column:
    return F.coalesce(first, F.lit(False)) & F.coalesce(second, F.lit(False)) & (F.coalesce(accuracy, F.lit(0.0)) >= 0.70)


def synthesis_pass(cross: Column, requirements: Column, overall: Column) -> Column:
    """No false cross check, and at least 70 % of nested requirements; without requirements the overall flag decides in their place."""
    flat = F.flatten(F.transform(F.map_values(requirements), F.map_values))
    rate = F.try_divide(F.size(F.filter(flat, lambda x: F.coalesce(x, F.lit(False)))), F.nullif(F.coalesce(F.size(flat), F.lit(0)), F.lit(0)))
    crossed = F.coalesce(F.forall(F.map_values(cross), lambda x: F.coalesce(x, F.lit(False))), F.lit(True))
    none = F.coalesce(F.size(flat), F.lit(0)) <= 0
    return crossed & F.when(none, F.coalesce(overall, F.lit(False))).otherwise(F.coalesce(rate >= 0.70, F.lit(False)))


def passes(task_type: Column, results: Column) -> Column:
    """The pass rule of the row's task type; other types fail.

    results: struct of flags map<string,boolean>, constraints_checked and cross_beat_constraints map<string,boolean>,
    beat_requirements map<string,map<string,boolean>>, structural_accuracy_score double, overall_pass boolean; all may be null.
    """
    flag = lambda k: F.try_element_at(results["flags"], F.lit(k))
    flags = F.struct(*[flag(k).alias(k) for k in dict.fromkeys((*K.INTERPOLATION_CRITERIA, *K.REVISION_CRITERIA, *K.CONVERSION_CRITERIA))])
    by_type = {
        "beat_interpolation": interpolation_pass(flags, K.INTERPOLATION_CRITERIA),
        "beat_revision": revision_pass(flags, K.REVISION_CRITERIA[:2], K.REVISION_CRITERIA[2:]),
        "constrained_continuation": continuation_pass(results["constraints_checked"]),
        "theory_conversion": conversion_pass(*[flag(k) for k in K.CONVERSION_CRITERIA], results["structural_accuracy_score"]),
        "multi_beat_synthesis": synthesis_pass(results["cross_beat_constraints"], results["beat_requirements"], results["overall_pass"]),
    }
    out = F.lit(False)
    for t, rule in by_type.items():
        out = F.when(task_type == t, rule).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _holds(value: Column, kind: str) -> Column:
    """Whether a variant is there and of a kind: string, array, object, boolean, integer, number, range, share, three, text100, 1..5, ^pattern, or one of a|b|c."""
    shape = F.schema_of_variant(value)
    number = value.isNotNull() & shape.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    at = lambda path, t: F.try_variant_get(value, path, t)
    if kind in ("string", "array", "object", "boolean"):
        return shape.startswith(kind.upper())
    if kind == "integer":
        return shape == "BIGINT"
    if kind == "number":
        return number
    if kind == "share":
        return number & at("$", "double").between(0, 1)
    if kind == "range":  # two whole numbers of 50 or more
        return shape.startswith("ARRAY<BIGINT") & (at("$[0]", "bigint") >= 50) & (at("$[1]", "bigint") >= 50) & (F.size(at("$", "array<variant>")) == 2)
    if kind == "three":
        return shape.startswith("ARRAY") & (F.size(at("$", "array<variant>")) == 3)
    if kind == "text100":
        return (shape == "STRING") & (F.length(at("$", "string")) >= 100)
    if kind.startswith("^"):
        return (shape == "STRING") & at("$", "string").rlike(kind)
    if ".." in kind:
        low, high = kind.split("..")
        return (shape == "BIGINT") & (at("$", "bigint") >= int(low)) & (F.lit(not high) | (at("$", "bigint") <= int(high or 0)))
    return (shape == "STRING") & at("$", "string").isin(kind.split("|"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def schema_violations(document: Column, task_type: Column, common: dict[str, str], by_type: dict[str, dict[str, str]]) -> Column:
    """Paths of a JSON document that break the rules for all and for its task type; a path that ends in ? may be absent.

    A document that doesn't parse breaks the rule "$". It is parsed once, and only the rules of its own type are looked at.
    """

    def broken(v: Column, path: str, kind: str) -> Column:
        def judge(value: Column) -> Column:
            wrong = ~F.coalesce(_holds(value, kind), F.lit(False))
            return F.when(value.isNotNull() & wrong if path.endswith("?") else wrong, F.lit(path.rstrip("?")))

        return _let(F.try_variant_get(v, f"$.{path.rstrip('?')}", "variant"), judge)

    def all_broken(v: Column, kind: Column) -> Column:
        own = F.array().cast("array<string>")
        for t, rules in by_type.items():
            own = F.when(kind == t, F.array(*[broken(v, p, k) for p, k in rules.items()])).otherwise(own)
        out = F.concat(F.array(*[broken(v, p, k) for p, k in common.items()]), own) if common else own
        return F.when(v.isNull(), F.array(F.lit("$"))).otherwise(F.array_compact(out))

    return _let(F.struct(F.try_parse_json(document).alias("v"), task_type.alias("t")), lambda s: all_broken(s["v"], s["t"]))
