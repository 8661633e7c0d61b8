"""Many phrases looked for at once: an automaton walks each text once, however many phrases there are.

The phrases go to the tasks with the function, and each Python worker builds
the automaton once. Counts are those of a plain search: for each phrase the
occurrences that don't overlap each other, from the left; occurrences of
different phrases may overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that are sent to tasks at most; a larger list is data and should be joined.
MOST = 1_000_000
_BUILT: dict = {}


class Automaton:
    """Finds all given phrases in one walk over a text; without the library for it, phrase by phrase."""

    def __init__(self, phrases: list[str]):
        self.phrases = phrases
        try:
            import ahocorasick
        except ImportError:
            self.walk = None
            return
        self.walk = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            self.walk.add_word(p, i)
        if phrases:
            self.walk.make_automaton()

    def counts(self, text: str) -> dict[int, int]:
        """Number of a phrase -> its occurrences that don't overlap; phrases that don't occur are left out."""
        if not self.phrases or not text:
            return {}
        if self.walk is None:
            return {i: n for i, p in enumerate(self.phrases) if (n := text.count(p))}
        found: dict[int, int] = {}
        free: dict[int, int] = {}  # where the next occurrence of a phrase may start
        for end, i in self.walk.iter(text):
            begin = end + 1 - len(self.phrases[i])
            if begin >= free.get(i, 0):
                found[i] = found.get(i, 0) + 1
                free[i] = end + 1
        return found


def automaton(phrases: list[str]) -> Automaton:
    """The automaton of a list of phrases, kept for the later tasks of a worker."""
    key = hashlib.sha256("\0".join(phrases).encode("utf-8", "surrogatepass")).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(phrases)
    return _BUILT[key]


def _checked(phrases: list[str]) -> list[str]:
    if len(phrases) > MOST:
        raise ValueError(f"more than {MOST} phrases")
    if not all(phrases):
        raise ValueError("a phrase is empty")
    return list(dict.fromkeys(phrases))


def phrase_counts(text: Column, phrases: list[str]) -> Column:
    """map<string,int>: how often each phrase that occurs in the lower-case text does so; null counts as empty. Repeated phrases count once."""
    listed = _checked(phrases)

    @F.pandas_udf("map<string,int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        walk = automaton(listed)
        for texts in batches:
            yield pd.Series([{listed[i]: n for i, n in walk.counts((t or "").lower()).items()} for t in texts], dtype="object")

    return run(text)


def phrase_weight(text: Column, weights: dict[str, float]) -> Column:
    """Sum of weight times count over all phrases in the lower-case text."""
    listed = _checked(list(weights))
    value = [weights[p] for p in listed]

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        walk = automaton(listed)
        for texts in batches:
            yield pd.Series([float(sum(value[i] * n for i, n in sorted(walk.counts((t or "").lower()).items()))) for t in texts], dtype="float64")

    return run(text)


def first_rule(question: Column, rules: list[tuple[str, list[str]]], otherwise: str = "NO") -> Column:
    """The answer of the first rule (answer, patterns) with a pattern inside the question, whatever its case; else ``otherwise``."""
    lowered = [[p.lower() for p in patterns] for _, patterns in rules]
    listed = _checked([p for patterns in lowered for p in patterns])
    first = {p: k for k in range(len(rules) - 1, -1, -1) for p in lowered[k]}
    rank, answers = [first[p] for p in listed], [a for a, _ in rules]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        walk = automaton(listed)
        for texts in batches:
            hits = [walk.counts((t or "").lower()) for t in texts]
            yield pd.Series([answers[min(rank[i] for i in h)] if h else otherwise for h in hits], dtype="object")

    return run(question)
