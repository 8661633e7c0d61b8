"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another; at each visit a shallow
tree over the feature's bins is fitted to the gradients and added to the
feature's lookup table, so that no feature can explain away another's share.
Pairs with the most remaining signal then get tables over two coarser bin
axes. Scoring is a sum of looked-up values, vectorised over rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a model is fitted on at most (the ids with the smallest hash).
FIT_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "punctuation", "bangs", "bars", "symbols", "spaces", "lines", "line_length", "distinct_words", "repeated_lines",
    "top_word", "stops", "capitalised", "short_words", "long_words", "other_bytes", "distinct_bytes", "top_byte", "repeated_pairs", "byte_entropy", "repeated_words_near",
)
_UPPER, _LOWER, _DIGIT = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@\\^_`{}~/", np.uint8)
_PUNCT = np.frombuffer(b"!\"'(),-.:;?[]|", np.uint8)


def features(text: bytes) -> list[float]:
    """The model's inputs, from the whole text alone; in the order of FEATURES."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    count = Counter(words)
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    firsts = np.frombuffer(b"".join([x[:1] for x in words]), np.uint8)
    letters = max(1.0, float(h @ (_UPPER + _LOWER)))
    p = h[h > 0] / n
    pairs = len(set(zip(words, words[1:])))
    near = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()), float(h @ _UPPER) / letters, float(h @ _DIGIT) / n, float(h[_PUNCT].sum()) / n, h[33] / w, h[124] / w, float(h[_SYMBOLS].sum()) / n, h[32] / n,
        len(lines) / w, n / max(1, len(lines)), len(count) / w, 1 - len(set(lines)) / max(1, len(lines)), max(count.values(), default=0) / w, (h[46] + h[63]) / w, float(_UPPER[firsts].sum()) / w,
        float((lengths <= 3).mean()), float((lengths > 20).mean()), float(h[128:].sum()) / n, float(len(p)), float(p.max()), 1 - pairs / max(1, len(words) - 1), float(-(p * np.log2(p)).sum()), near / w,
    ]


@dataclass
class Model:
    """Lookup tables over bins; ``edges`` are each feature's bin borders."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for (i, j), t in self.pairs.items():
            out += t[bins[:, i] // self.coarse, bins[:, j] // self.coarse]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3, smooth: float = 5.0) -> np.ndarray:
    """Value per bin of a tree with few leaves: splits where the summed gradients gain most."""
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gain = (g[m] - g[a]) ** 2 / (w[m] - w[a] + smooth) + (g[b] - g[m]) ** 2 / (w[b] - w[m] + smooth) - (g[b] - g[a]) ** 2 / (w[b] - w[a] + smooth)
            best = max(best, (float(gain.max()), int(m[gain.argmax()])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    return np.concatenate([np.full(b - a, (g[b] - g[a]) / (w[b] - w[a] + smooth)) for a, b in zip(cuts, cuts[1:])])


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 150, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1) -> Model:
    """Cyclic boosting; a constant model where there are no rows, or one class only."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    model = Model(float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = model.bins(x)
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-raw))
            step = rate * shallow_tree(np.bincount(bins[:, j], y - p, len(t)), np.bincount(bins[:, j], p * (1 - p), len(t)))
            t += step
            raw += step[bins[:, j]]
    side = n_bins // model.coarse + 1
    cells = {(i, j): bins[:, i] // model.coarse * side + bins[:, j] // model.coarse for i, j in combinations(range(x.shape[1]), 2)}

    def by_cell(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return np.bincount(c, y - p, side * side), np.bincount(c, p * (1 - p), side * side)

    gains = {k: float((g * g / (w + 5)).sum()) for k, c in cells.items() for g, w in [by_cell(c)]}
    for k in sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]:
        model.pairs[k] = np.zeros((side, side))
    for _ in range(pair_rounds):
        for k, t in model.pairs.items():
            g, w = (v.reshape(side, side) for v in by_cell(cells[k]))
            split = shallow_tree(g.sum(1), w.sum(1), 2)  # one cut on the first axis, then a tree on the second for either part
            upper = split != split[0]
            step = np.zeros_like(t)
            for part in (upper, ~upper):
                if part.any():
                    step[part] = rate * shallow_tree(g[part].sum(0), w[part].sum(0))
            t += step
            raw += step.ravel()[cells[k]]
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out of fitting."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled documents that aren't held out; labels: (doc_id, quality), null labels are ignored."""
    known = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # the bound that allows the broadcast
    rows = docs.select("doc_id", common.text_bytes().alias("t")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("t").alias("t"))
    width = len(FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["quality"].astype("float64"), "x": [features(t) for t in pdf["t"]]})

    slim = rows.select("doc_id", "quality", "t")
    got = slim.mapInPandas(run, "doc_id long, y double, x array<double>").toPandas().sort_values("doc_id")
    return fit(np.array(got["x"].tolist(), np.float64).reshape(-1, width), got["y"].to_numpy())


def scorer(model: Model):
    """A column function from text bytes to scores between 0 and 1."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:  # the model goes with the function: some thousand numbers, whatever the data
            yield pd.Series(model.score(np.array([features(t) for t in s], np.float64).reshape(len(s), len(FEATURES))))

    return score


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts are scored like others (all features zero). Repeated rows get equal scores; a null doc_id counts as not
    held out. Without labels every score is 0.5. An empty table gives an empty result.
    """
    found = scorer(fit_on(docs, labels))
    out = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), found(common.text_bytes()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality(spark, sf_dir):
    """Query: quality of every document."""
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
