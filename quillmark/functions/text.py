"""Text scoring as columns and relational plans: word counts, repetition, overused phrases."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it occurs."""
    return F.transform(F.array(value), use)[0]


#: Inside (?U)[...]: every character that counts as white space, which is Unicode's own and the separators U+001C to U+001F.
_SPACE = r"\s\x1c-\x1f"


def word_count(text: Column) -> Column:
    """Number of words, separated by white space of any kind; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?U)[^{_SPACE}]+"))


def blank(text: Column) -> Column:
    """Whether a text is null or holds white space only."""
    return ~F.coalesce(text, F.lit("")).rlike(f"(?U)[^{_SPACE}]")


#: Where a run of letters, digits and underscores starts and ends.
_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters only; a run with any other letter, digit or underscore gives nothing."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{_START}[a-z]++{_END}"), F.lit(0))


def sentences(text: Column) -> Column:
    """Non-empty trimmed parts between full stops, exclamation and question marks."""
    trim = lambda x: F.regexp_replace(x, f"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), trim), lambda x: x != "")


def word_range(task_type: Column, low: Column | None = None, high: Column | None = None) -> tuple[Column, Column]:
    """Target word range: the task's own, or its type's default."""
    ends = []
    for k, own in enumerate((low, high)):
        default = F.lit((300, 600)[k])
        for t, pair in K.WORD_RANGES.items():
            default = F.when(task_type == t, F.lit(pair[k])).otherwise(default)
        ends.append(F.coalesce(own, default) if own is not None else default)
    return ends[0], ends[1]


def _deviation(words: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - words, words - high, F.lit(0)).cast("double")


def gaussian_score(words: Column, low: Column, high: Column) -> Column:
    d = _deviation(words, low, high)
    sigma = F.greatest((high - low).cast("double") * 0.8, F.lit(50.0))
    return F.when(d == 0, 1.0).otherwise(F.exp(-(d * d) / (sigma * sigma * 2)))


def tanh_score(words: Column, low: Column, high: Column) -> Column:
    return F.lit(1.0) - F.tanh(_deviation(words, low, high) * 0.02)


def sigmoid_score(words: Column, low: Column, high: Column) -> Column:
    """Falls to 0 where the exponential overflows."""
    return F.lit(2.0) / (F.exp(_deviation(words, low, high) * 0.03) + 1)


METHODS = {"gaussian": gaussian_score, "tanh": tanh_score, "sigmoid": sigmoid_score}


def word_count_score(words: Column, low: Column, high: Column, method: str = "gaussian") -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown word count method: {method}")
    return let(words, lambda w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), METHODS[method](w, low, high))))


_WORD = re.compile(r"\b[a-z]+\b")


def repetition_of(words: list[str], stop_words: frozenset[str]) -> float:
    """1 less 0.02 for each use of a content word above its threshold and 0.03 for each of a word pair above three.

    Texts below 20 words or 10 content words score 0.7; the penalty is at most 0.5.
    """
    content = Counter(w for w in words if len(w) > 2 and w not in stop_words)
    total = content.total()
    if len(words) < 20 or total < 10:
        return 0.7
    threshold = max(3.0, 2.0 * total / len(content))
    over = sum((n - threshold) * 0.02 for n in content.values() if n > threshold)
    pairs = sum((n - 3) * 0.03 for n in Counter(zip(words, words[1:])).values() if n > 3)
    return 1.0 - min(0.5, over + pairs)


def slop_of(low: str, words: list[str], lexicon: dict[str, float], phrases: dict[str, float]) -> float:
    """1 less 5 % for each overused word or phrase (by weight) per hundred words; below 20 words 0.8. Words inside phrases count twice."""
    if len(words) < 20:
        return 0.8
    penalty = sum(lexicon[w] for w in words if w in lexicon) + sum(low.count(p) * v for p, v in phrases.items())
    return max(0.0, 1.0 - penalty / len(words) * 100 * 0.05)


def _scored(score) -> Column:
    """An Arrow batch function of each text's lower-case form and words; a row is scored where it stands, so there is no shuffle."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            lower = [(t or "").lower() for t in texts]
            yield pd.Series([score(low, _WORD.findall(low)) for low in lower], dtype="float64")

    return run


def repetition_score(text: Column, stop_words: list[str] | None = None) -> Column:
    """``repetition_of`` each row's text; null counts as empty, and rows that share an id stay apart."""
    stops = frozenset(K.STOP_WORDS if stop_words is None else stop_words)
    return _scored(lambda low, words: repetition_of(words, stops))(text)


def repetition_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """(key, repetition_score) of every row."""
    return docs.select(key, repetition_score(F.col(text), stop_words).alias("repetition_score"))


def slop_score(text: Column, words: dict[str, float] | None = None, phrases: dict[str, float] | None = None) -> Column:
    """``slop_of`` each row's text, by the fixed lists or a caller's own; null counts as empty."""
    lexicon, listed = K.OVERUSED_WORDS if words is None else words, K.OVERUSED_PHRASES if phrases is None else phrases
    return _scored(lambda low, found: slop_of(low, found, lexicon, listed))(text)


def repetition_and_slop(text: Column) -> Column:
    """struct<repetition, slop> by the fixed lists: both scores of a text that is lower-cased and cut into words once."""
    stops, lexicon, listed = frozenset(K.STOP_WORDS), K.OVERUSED_WORDS, K.OVERUSED_PHRASES

    @F.pandas_udf("repetition double, slop double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            both = []
            for low in [(t or "").lower() for t in texts]:
                words = _WORD.findall(low)
                both.append((repetition_of(words, stops), slop_of(low, words, lexicon, listed)))
            yield pd.DataFrame(both, columns=["repetition", "slop"], dtype="float64")

    return run(text)


def programmatic_score(words: Column, repetition: Column, slop: Column) -> Column:
    return words * 0.40 + repetition * 0.35 + slop * 0.25


def final_score(programmatic: Column, judge: Column, weights: tuple[float, float] = (0.5, 0.5)) -> Column:
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    return programmatic * weights[0] + judge * weights[1]


def response_class(completion: Column, reasoning: Column, output: Column, finish: Column) -> Column:
    """What is wrong with a model's response, or null: reasoning_only, content_filtered or bad_finish, in this order."""
    empty = (completion > 0) & blank(output)
    mostly = (reasoning > 0) & (reasoning >= completion * 0.9)
    return F.when(empty & mostly, "reasoning_only").when(empty, "content_filtered").when(F.coalesce(finish, F.lit("")).isin("", "stop"), F.lit(None)).otherwise("bad_finish")


def beat_budget(low: Column, high: Column, beats: Column) -> tuple[Column, Column]:
    """Word budget of each beat."""
    return F.floor(low / beats), F.floor(high / beats)
