"""Pairwise significance: Student's t, Cohen's d, effect labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the continued fraction: enough for a million degrees of freedom.
STEPS = 200


def moments(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Sufficient statistics of each group: all that the tests need."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def pairwise(rows: DataFrame, group: str = "model", value: str = "score") -> DataFrame:
    """All pairs of groups with at least two values, the first name first: t, d, effect label.

    The pairing joins one row for each group, never the values. Equal constants give t null and d 0.
    """
    m = moments(rows, group, value).where("n >= 2")
    a, b = (m.select(*[F.col(c).alias(f"{c}_{s}") for c in m.columns]) for s in "ab")
    p = a.join(b, F.col("g_a") < F.col("g_b"))
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2)
    p = p.withColumn("pooled", pooled).withColumn("difference", F.col("mean_a") - F.col("mean_b"))
    t = F.when(F.col("pooled") > 0, F.col("difference") / F.sqrt(F.col("pooled") * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b"))))
    d = F.when(F.col("pooled") > 0, F.col("difference") / F.sqrt("pooled")).otherwise(0.0)
    p = p.withColumn("t", t).withColumn("cohens_d", d)
    size = F.abs("cohens_d")
    label = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return p.select(F.col("g_a").alias("model_a"), F.col("g_b").alias("model_b"), "n_a", "n_b", "mean_a", "mean_b", "difference", "t", (F.col("n_a") + F.col("n_b") - 2).alias("df"), "cohens_d", label.alias("effect"))


def _stirling(x: Column) -> Column:
    """What Stirling's formula leaves out of log gamma, for x of 10 or more."""
    y = F.lit(1.0) / (x * x)
    series = ((((y * (-691.0 / 360360) + 1.0 / 1188) * y - 1.0 / 1680) * y + 1.0 / 1260) * y - 1.0 / 360) * y + 1.0 / 12
    return series / x


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series at z + 10, less the logarithms of the ten factors in between."""
    x = z + 10
    shift = sum((F.log(z + i) for i in range(1, 10)), F.log(z))
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + _stirling(x) - shift


def log_beta(p: Column, q: Column) -> Column:
    """Logarithm of the beta function; the large terms of a large argument are taken off before anything is rounded."""
    large, small = F.greatest(p, q), F.least(p, q)
    x = large + 10
    rising = (x - 0.5) * F.log1p(small / x) + small * F.log(x + small) - small + _stirling(x + small) - _stirling(x)
    return log_gamma(small) - rising + sum((F.log1p(small / (large + i)) for i in range(1, 10)), F.log1p(small / large))


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column | None = None, steps: int = STEPS) -> Column:
    """Regularised incomplete beta function for a, b > 0 and 0 <= x <= 1: Lentz's continued fraction as a fold of a fixed number of steps.

    ``rest`` is 1 - x, where it is known better than that.
    """
    rest = F.lit(1.0) - x if rest is None else rest
    turned = x > (a + 1) / (a + b + 2)
    args = F.struct(F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b"), F.when(turned, rest).otherwise(x).alias("x"), F.when(turned, x).otherwise(rest).alias("rest"))
    kept = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def fraction(s: Column) -> Column:
        p, q, y = s["a"], s["b"], s["x"]
        first = F.lit(1.0) / kept(F.lit(1.0) - (p + q) * y / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

        def half(w: Column, numerator: Column) -> Column:
            d, c = F.lit(1.0) / kept(numerator * w["d"] + 1), kept(numerator / w["c"] + 1)
            return F.transform(F.array(F.struct(c.alias("c"), d.alias("d"))), lambda e: F.struct(e["c"].alias("c"), e["d"].alias("d"), (w["h"] * e["d"] * e["c"]).alias("h")))[0]

        def step(w: Column, m: Column) -> Column:
            even = m * (q - m) * y / ((p + m * 2 - 1) * (p + m * 2))
            odd = -(p + m) * (p + q + m) * y / ((p + m * 2) * (p + m * 2 + 1))
            return half(half(w, even), odd)

        h = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda w: w["h"])
        log = lambda u, v: F.when(u > 0.5, F.log1p(-v)).otherwise(F.log(u))
        front = F.exp(p * log(y, s["rest"]) + q * log(s["rest"], y) - log_beta(p, q)) / p
        return F.when(y <= 0, 0.0).otherwise(front * h)

    value = F.transform(F.array(args), fraction)[0]
    return F.when(turned, F.lit(1.0) - value).otherwise(value)


def with_p_values(pairs: DataFrame) -> DataFrame:
    """Two-sided p of Student's t, and significance at 0.05; null t gives null p and no significance."""
    df = F.col("df").cast("double")
    square = F.col("t") * F.col("t")
    p = incomplete_beta(df / 2, F.lit(0.5), df / (df + square), square / (df + square))
    return pairs.withColumn("p", F.when(F.col("t").isNotNull(), p)).withColumn("significant", F.coalesce(F.col("p") < 0.05, F.lit(False)))
