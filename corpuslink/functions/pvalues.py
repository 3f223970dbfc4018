"""P-values and small adjustments on result rows (T27, T28): vectorised over the few rows a test returns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: float) -> float:
    """P(χ² > x): one minus the series of the lower incomplete gamma, or the continued fraction of the upper."""
    if not x > 0:
        return 1.0
    a, x = df / 2, x / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15 and n < a + 2000:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    # upper gamma by backward evaluation of its continued fraction
    value = 0.0
    for i in range(400, 0, -1):
        value = i * (i - a) / (x + 2 * i + 1 - a - value)
    return min(1.0, scale / (x + 1 - a - value))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta I_x(a, b), by its continued fraction on the side where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    # the fraction's convergents as ratios of successive numerators and denominators
    up, down, value = 1.0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1))
    for m in range(1, 10_000):
        for odd in (False, True):
            k = (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))) if odd else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
            down, up = 1 / (1 + k * down), 1 + k / up
            value *= up * down
        if abs(up * down - 1) < 1e-15:
            break
    return front * value


def t_tails(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|); beyond 10^7 degrees of freedom the normal one, which differs by less than 10^-7."""
    if df <= 0:
        return 1.0
    if df > 1e7:
        return 2 * normal_tail(abs(float(t)))
    return float(min(1.0, beta_share(df / (df + t * t), df / 2, 0.5)))


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p."""
    return z.map(lambda v: None if pd.isna(v) else 2 * normal_tail(abs(v)))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(d) else chi2_tail(v, d) for v, d in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or pd.isna(d) else t_tails(v, d) for v, d in zip(t, df)], dtype="float64")


def holm(tests: DataFrame, by: list[str], p: str, key: str, name: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment over the tests of a family (a few result rows)."""
    order = W.partitionBy(*by).orderBy(p, key)
    family = W.partitionBy(*by)
    raw = F.least(F.lit(1.0), (F.count(p).over(family) - F.row_number().over(order) + 1) * F.col(p))
    rows = tests.withColumn("_raw", raw)
    return rows.withColumn(name, F.max("_raw").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_raw")


def benjamini_hochberg(tests: DataFrame, by: list[str], p: str, key: str, name: str = "q") -> DataFrame:
    """Benjamini–Hochberg q-values over the tests of a family (a few result rows); nulls stay null."""
    known = F.col(p).isNotNull()
    order = W.partitionBy(*by, known).orderBy(p, key)
    raw = F.col(p) * F.count(p).over(W.partitionBy(*by)) / F.row_number().over(order)
    rows = tests.withColumn("_raw", F.when(known, F.least(F.lit(1.0), raw)))
    back = W.partitionBy(*by, known).orderBy(F.desc(p), F.desc(key)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(name, F.min("_raw").over(back)).drop("_raw")


@F.pandas_udf(DoubleType())
def poisson_draw(mean: pd.Series, u: pd.Series) -> pd.Series:
    """The Poisson value a uniform number stands for; the normal one for large means."""
    m, q = mean.to_numpy(float), np.clip(u.to_numpy(float), 1e-12, 1 - 1e-12)
    small = m < 50
    out = np.zeros(len(m))
    if small.any():
        lam, target = m[small], q[small]
        term = np.exp(-lam)
        total, value = term.copy(), np.zeros(len(lam))
        for k in range(1, 200):
            value += total < target
            term = term * lam / k
            total = total + term
        out[small] = value
    if (~small).any():
        from statistics import NormalDist

        z = np.array([NormalDist().inv_cdf(v) for v in q[~small]])
        out[~small] = np.maximum(0, np.rint(m[~small] + np.sqrt(m[~small]) * z))
    return pd.Series(out)


# ---- verbal labels (T27). Thresholds.
SCALES = {
    "strength": ((0.1, "hardly any relation"), (0.3, "a weak relation"), (0.5, "a moderate relation"), (None, "a strong relation")),
    "gini": ((0.3, "evenly shared"), (0.5, "somewhat uneven"), (0.7, "uneven: a minority carries most"),
             (None, "very uneven: a few carry most of it")),
    "alpha": ((0.667, "weak agreement"), (0.8, "enough agreement for tentative conclusions"), (None, "strong agreement")),
    "kappa": ((0.4, "weak agreement"), (0.6, "moderate agreement"), (0.8, "substantial agreement"), (None, "almost perfect agreement")),
    "r2": ((0.1, "a small part"), (0.2, "a usual share for human judgement"), (None, "a very good share for human judgement")),
    "somers": ((0.2, "an order hardly better than chance"), (0.4, "a fair order"), (0.6, "a good order"), (None, "a very good order")),
    "epsilon2": ((0.01, "a negligible difference"), (0.06, "a small difference"), (0.14, "a medium difference"),
                 (None, "a large difference")),
    "cliff": ((0.15, "a negligible difference"), (0.33, "a small difference"), (0.47, "a medium difference"),
              (None, "a large difference"))}


def verbal(kind: str, value: Column) -> Column:
    """The words for a statistic (T27): sizes of relations and differences are read without their sign."""
    size = F.abs(value) if kind in ("strength", "cliff") else value
    out = F.lit(SCALES[kind][-1][1])
    for limit, words in reversed(SCALES[kind][:-1]):
        out = F.when(size < limit, F.lit(words)).otherwise(out)
    return F.when(value.isNull(), F.lit("not measurable")).otherwise(out)

