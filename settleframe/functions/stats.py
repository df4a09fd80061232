"""Tests from sufficient statistics. The p-values run in pandas, over the few aggregated rows only."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if df <= 0 or math.isnan(t):
        return math.nan
    return _beta_tail(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


@F.pandas_udf(DoubleType())
def normal_upper_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(v / math.sqrt(2)) / 2, na_action="ignore")


@F.pandas_udf(DoubleType())
def student_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else student_p(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def two_proportion_z(won1: Column, n1: Column, won2: Column, n2: Column) -> Column:
    """Pooled z of two shares; 0 without spread."""
    pooled = (won1 + won2) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return F.when(se == 0, F.lit(0.0)).otherwise((won1 / n1 - won2 / n2) / F.nullif(se, F.lit(0.0)))


def welch(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column]:
    """t and Welch-Satterthwaite degrees of freedom, from sizes, means and sample variances."""
    a, b = v1 / n1, v2 / n2
    t = (m1 - m2) / F.nullif(F.sqrt(a + b), F.lit(0.0))
    return t, (a + b) ** 2 / F.nullif(a**2 / (n1 - 1) + b**2 / (n2 - 1), F.lit(0.0))


def correlation_t(r: Column, n: Column) -> Column:
    """Student's t of a correlation of n pairs, with n - 2 degrees of freedom; null for fewer than three pairs, infinite for r = 1 and -1."""
    rest = 1 - r * r
    t = r * F.sqrt((n - 2) / F.nullif(rest, F.lit(0.0)))
    return F.when(n > 2, F.when(rest <= 0, r * F.lit(float("inf"))).otherwise(t))


def cohens_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    sd = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when(sd == 0, F.lit(0.0)).otherwise((m1 - m2) / F.nullif(sd, F.lit(0.0)))
