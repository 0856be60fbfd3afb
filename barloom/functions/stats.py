"""Distribution functions that neither Spark nor SQL has, as Arrow-batched functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse of the normal distribution by bisection on its own function (exact to 1e-12)."""
    if not 0 < p < 1:
        return math.nan if not 0 <= p <= 1 else math.copysign(math.inf, p - 0.5)
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function (series below a + 1, continued fraction above)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def chi2_sf(x: float, df: int) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def t_ppf(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _each(f):
    def over(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*columns)], dtype="float64")

    return over


def two_sided_p(statistic: Column) -> Column:
    """2 (1 - Phi(|z|)); null for a null statistic."""

    def batch(z: pd.Series) -> pd.Series:
        return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)))(z)

    return F.pandas_udf(batch, "double")(statistic)


def chi2_p(statistic: Column, df: int) -> Column:
    def batch(x: pd.Series) -> pd.Series:
        return _each(lambda v: chi2_sf(v, df))(x)

    return F.pandas_udf(batch, "double")(statistic)


def gaussian_crps(y: Column, mean: Column, scale: Column) -> Column:
    def one(a: float, m: float, s: float) -> float:
        z = (a - m) / s
        return s * (z * (2 * normal_cdf(z) - 1) + 2 * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))

    def batch(a: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        return _each(one)(a, m, s)

    return F.pandas_udf(batch, "double")(y, mean, scale)


def normal_pit(y: Column, mean: Column, scale: Column) -> Column:
    def batch(a: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        return _each(lambda v, u, d: normal_cdf((v - u) / d))(a, m, s)

    return F.pandas_udf(batch, "double")(y, mean, scale)


def half_width(deviation: Column, n: Column, level: float = 0.95) -> Column:
    """Half width of the Student interval of a mean; null below two values."""

    def batch(s: pd.Series, k: pd.Series) -> pd.Series:
        return _each(lambda d, m: t_ppf(0.5 + level / 2, m - 1) * d / math.sqrt(m) if m > 1 else math.nan)(s, k)

    return F.pandas_udf(batch, "double")(deviation, n.cast("double"))
