"""Derived names, identities and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def task_type_of(task_id: Column) -> Column:
    """The id without its last underscore part; the whole id without an underscore."""
    return F.regexp_replace(task_id, r"_[^_]*$", "")


def is_agentic(task_type: Column) -> Column:
    return task_type.startswith("agentic_") | (task_type == "critique_improvement")


def short_name(model: Column) -> Column:
    return F.substring_index(model, "/", -1)


def company(model: Column) -> Column:
    return F.when(F.instr(model, "/") > 0, F.substring_index(model, "/", 1)).otherwise("unknown")


def company_name(model: Column, shown: dict[str, str] | None = None) -> Column:
    """Name of a model's company as in the leaderboard (or as in ``shown``); others in title case, each run of letters on its own."""
    names = F.create_map(*[F.lit(x) for pair in (K.COMPANY_NAMES if shown is None else shown).items() for x in pair])
    c = company(model)
    return F.coalesce(F.try_element_at(names, c), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), ""))


def display_name(model: Column) -> Column:
    name = short_name(model)
    out = name
    for prefix, shown in (("claude-", "Claude "), ("gpt-", "GPT-"), ("gemini-", "Gemini "), ("deepseek-", "DeepSeek "), ("grok-", "Grok ")):
        out = F.when(name.startswith(prefix), F.replace(name, F.lit(prefix), F.lit(shown))).otherwise(out)
    return out


def file_stem(task_id: Column, model: Column, sample: Column) -> Column:
    """Name of a stored generation: slashes become underscores."""
    return F.concat_ws("_", task_id, F.replace(model, F.lit("/"), F.lit("_")), sample.cast("string"))


def token_cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars for tokens at prices per million."""
    return prompt / 1e6 * price_in + completion / 1e6 * price_out


def output_tokens(completion: Column, reasoning: Column) -> Column:
    """Tokens besides reasoning; negative where a provider reports more reasoning than completion."""
    return completion - reasoning


def token_limits(task_type: Column) -> tuple[Column, Column]:
    """(most tokens, most reasoning tokens) of a task type."""
    out = []
    for k in range(2):
        c = F.lit((4000, 1024)[k])
        for t, v in K.TOKEN_LIMITS.items():
            c = F.when(task_type == t, v[k]).otherwise(c)
        out.append(c)
    return out[0], out[1]
