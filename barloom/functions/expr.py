"""Scalar expressions and small aggregates, all evaluated in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor of a variance, and the bounds of the two QLIKE variants.
EPSILON = 1e-12
LOG_RATIO_BOUND = 50.0
LOG_LEVEL_BOUND = 40.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: Column | str) -> Column:
    """NaN and infinities become null: one notion of a missing number."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def floored(c: Column, least: float = EPSILON) -> Column:
    """greatest(c, least), but null stays null (greatest alone skips nulls)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(least)))


def log_ratio(a: str, b: str) -> Column:
    return F.ln(F.col(a) / F.col(b))


def garman_klass() -> Column:
    """Raw Garman-Klass variance of a bar; may be zero or negative."""
    return F.lit(0.5) * F.pow(log_ratio("high", "low"), 2) - F.lit(2 * math.log(2) - 1) * F.pow(log_ratio("close", "open"), 2)


def parkinson() -> Column:
    return F.pow(log_ratio("high", "low"), 2) / F.lit(4 * math.log(2))


def log_variance(raw: Column, epsilon: float = EPSILON) -> Column:
    return F.ln(floored(raw, epsilon) + F.lit(epsilon))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def qlike(actual: Column, predicted: Column) -> Column:
    """Quasi-likelihood loss of log variances; the log ratio is bounded."""
    d = F.greatest(F.least(actual - predicted, F.lit(LOG_RATIO_BOUND)), F.lit(-LOG_RATIO_BOUND))
    return F.when(actual.isNotNull() & predicted.isNotNull(), F.exp(d) - d - 1)


def qlike_levels(actual: Column, predicted: Column) -> Column:
    """The other variant: each log variance is bounded, predicted variance and ratio are floored."""

    def level(c: Column) -> Column:
        return F.exp(F.greatest(F.least(c, F.lit(LOG_LEVEL_BOUND)), F.lit(-LOG_LEVEL_BOUND)))

    q = F.greatest(level(actual) / F.greatest(level(predicted), F.lit(EPSILON)), F.lit(EPSILON))
    return F.when(actual.isNotNull() & predicted.isNotNull(), q - F.ln(q) - 1)


def huber(residual: Column, delta: float = 1.0) -> Column:
    a = F.abs(residual)
    return F.when(a <= delta, 0.5 * residual * residual).otherwise(delta * (a - 0.5 * delta))


def gain(reference: Column, candidate: Column, lower_is_better: bool) -> Column:
    """Relative improvement over a reference value; positive is better."""
    change = reference - candidate if lower_is_better else candidate - reference
    return change / F.greatest(F.abs(reference), F.lit(EPSILON))


def correlation(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation of a group; null below `least` pairs or when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) >= least, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, t: s + t)


def unit(x: Column) -> Column:
    """L2-normalised array; null for a zero vector."""
    norm = F.sqrt(dot(x, x))
    return F.when(norm > 0, F.transform(x, lambda v: v.cast("double") / norm))


def softmax(x: Column, temperature: float) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp((v - top) / F.lit(temperature)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, t: s + t))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, v: s + F.when(v > 0, v * F.ln(v)).otherwise(F.lit(0.0)))


def uniform(*keys: Column | str) -> Column:
    """Portable uniform number in [0, 1) of a key: the same in any engine with SHA-256."""
    text = F.concat_ws("|", *(col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long").cast("double") / F.lit(float(1 << 32))


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "1.0", "yes", "y"), F.lit(False))


def blank_normalised(c: Column | str) -> Column:
    """Zero-width marks removed, every kind of blank collapsed to one, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"[\u200B\uFEFF]", ""), r"(?U)\s+", " "))


# Texts that stand for a missing text, lower case.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "nan", "none", "null", "no news", "no_news", "not available", "[]", "{}")


def is_placeholder(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))).isin(*PLACEHOLDERS), F.lit(True))


def sorted_union(c: Column) -> Column:
    """Aggregate: sorted distinct elements of an array column, nulls dropped.  Equal arrays are kept once
    while aggregating, so a group of many equal rows stays small."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.filter(c, lambda v: v.isNotNull()))))))
