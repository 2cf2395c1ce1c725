"""Exact binomial statistics, one row per group, at any count: incomplete beta functions instead of sums."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + numerator * d) or tiny)
            c = (1 + numerator / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X binomial(n, p)."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_share(p, k, n - k + 1)


def cp_lower(k: int, n: int, alpha: float) -> float:
    """The p at which k successes or more of n have probability alpha."""
    low, high = 0.0, 1.0
    if not k:
        return 0.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if upper_tail(k, n, middle) < alpha else (low, middle)
    return low


def clopper_pearson(successes: Column, trials: Column, alpha: float = 0.05) -> Column:
    """One-sided exact lower bound; null without trials."""

    @F.pandas_udf(T.DoubleType())
    def bound(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if not b or b != b else cp_lower(int(a), int(b), alpha) for a, b in zip(k, n, strict=True)], dtype="float64")

    return bound(successes.cast("long"), trials.cast("long"))


def sign_test(improved: Column, discordant: Column) -> Column:
    """Exact one-sided sign test; 1 without discordant pairs."""

    @F.pandas_udf(T.DoubleType())
    def p(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([upper_tail(int(a), int(b), 0.5) if b else 1.0 for a, b in zip(k, n, strict=True)], dtype="float64")

    return p(improved.cast("long"), discordant.cast("long"))


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval; null without trials."""
    n, p = trials.cast("double"), F.try_divide(successes.cast("double"), trials.cast("double"))
    middle = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    return F.try_divide(middle - half, scale), F.try_divide(middle + half, scale)
