"""Column expressions with the null, division and quantile rules of the engine.

Sums and means are strict where a missing value must make the result missing; divisions by zero
give null; membership of null is false; quantiles interpolate linearly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILES = (0.05, 0.10, 0.50, 0.90, 0.95)


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    return F.when(F.abs(x) < F.lit(math.inf), x)


def strict_sum(x: Column) -> Column:
    """Sum that is null if any value is null."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.sum(x))


def strict_avg(x: Column) -> Column:
    """Mean that is null if any value is null."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.avg(x))


def safe_div(x: Column, y: Column) -> Column:
    """``x / y``, null where y is zero."""
    return F.try_divide(x, y)


def isin_false(x: Column, values: Sequence) -> Column:
    """Membership; false for null."""
    return F.coalesce(x.isin(*values), F.lit(False)) if values else F.lit(False)


def percentiles(x: Column, qs: Sequence[float] = QUANTILES) -> Column:
    """Exact quantiles with linear interpolation, nulls left out."""
    return F.percentile(x, F.array(*map(F.lit, qs)))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def array_quantile(values: Column, q: float) -> Column:
    """Quantile of an ascending array without nulls, with linear interpolation; null for none."""
    at = (F.size(values) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def month_of(d: Column) -> Column:
    """First day of the month."""
    return F.trunc(d, "MM").cast("date")


def window_year(month: Column, year_end_month: int = 12) -> Column:
    """Reporting year that a month belongs to, named by the year it closes in."""
    return F.year(F.add_months(month, 12 - year_end_month))


def window_start(year: Column, year_end_month: int = 12) -> Column:
    """First month of a reporting year."""
    return F.add_months(F.make_date(year, F.lit(year_end_month), F.lit(1)), -11)


def poisson_lower(k: Column, rate: Column) -> Column:
    """P(X <= k) of a Poisson count; null unless the rate is finite and positive and k is given."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, rate: pd.Series) -> pd.Series:
        a, b = k.to_numpy(float), rate.to_numpy(float)
        known = np.isfinite(a) & np.isfinite(b) & (b > 0)
        out = np.full(len(a), None, object)
        out[known] = poisson_cdf(np.trunc(a[known]), b[known])
        return pd.Series(out)

    return tail(k.cast("double"), rate.cast("double"))


def poisson_cdf(k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """P(X <= k) of each row: the shorter tail, summed by ratios from its largest term, all rows a term at a time."""
    shape = np.shape(k)
    k, rate = np.atleast_1d(np.asarray(k, float)), np.atleast_1d(np.asarray(rate, float))
    lower = k <= rate
    first = np.where(lower, k, k + 1)
    n, term, total = first.copy(), np.ones(len(k)), np.ones(len(k))
    left = k >= 0
    while left.any():
        term = np.where(left, term * np.where(lower, n / rate, rate / np.maximum(n + 1, 1)), 0.0)
        n = n + np.where(lower, -1, 1)
        total = total + term
        left &= (term > 1e-17 * total) & (~lower | (n > 0))
    logs = first * np.log(rate) - rate - np.array([math.lgamma(max(f, -0.5) + 1) for f in first])
    tail = total * np.exp(logs)
    return np.where(k < 0, 0.0, np.where(lower, np.minimum(1.0, tail), np.maximum(0.0, 1 - tail))).reshape(shape)


def binomial_two_sided(b: int, c: int) -> float:
    """Exact two-sided p of b against c at even odds; 1 if they are equal."""
    n, k = b + c, min(b, c)
    if b == c:
        return 1.0
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact McNemar p of the discordant counts; null without any."""

    @F.pandas_udf("double")
    def p(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([binomial_two_sided(int(x), int(y)) if x + y > 0 else None for x, y in zip(b, c, strict=True)], dtype=object)

    return p(b, c)


def student_tail(t: float, df: int) -> float:
    """Two-sided p of Student's t with whole degrees of freedom."""
    if not math.isfinite(t):
        return 0.0
    x = df / (df + t * t)
    return incomplete_beta(df / 2, 0.5, x)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    value = 0.0
    for m in range(300, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    return front / a / (1 + first / (1 + value))


def slope_p(n: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Two-sided p of a least-squares slope; null below three points, 0 for a perfect fit."""

    @F.pandas_udf("double")
    def p(n: pd.Series, sxx: pd.Series, syy: pd.Series, sxy: pd.Series) -> pd.Series:
        out = []
        for k, xx, yy, xy in zip(n, sxx, syy, sxy, strict=True):
            if not k or k < 3 or not xx or pd.isna(xx):
                out.append(None)
                continue
            rest = max(0.0, yy - xy * xy / xx)
            out.append(0.0 if rest <= 1e-14 * max(yy, 1e-300) else student_tail(xy / xx / math.sqrt(rest / (k - 2) / xx), int(k) - 2))
        return pd.Series(out, dtype=object)

    return p(n, sxx, syy, sxy)
