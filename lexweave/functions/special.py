"""Measures that need log-gamma, which Spark lacks, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log(gamma(x)), computed once for each different value; NaN below and at 0."""
    x = np.asarray(x, float)
    values, at = np.unique(x, return_inverse=True)
    ok = values > 0
    out = np.full(len(values), np.nan)
    out[ok] = _lgamma(values[ok]).astype(float)
    return out[at]


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def bayes_llr_values(a, b, c, d, smooth: float = 0.5) -> np.ndarray:
    parts = log_beta(a + smooth, b + smooth) + log_beta(c + smooth, d + smooth)
    return 2.0 * (parts - log_beta(a + c + smooth, b + d + smooth) - float(log_beta(np.array([smooth]), np.array([smooth]))[0]))


def bayes_llr(a: Column, b: Column, c: Column, d: Column, smooth: float = 0.5) -> Column:
    """Logarithm of a Bayes factor; null where a smoothed cell isn't positive."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(bayes_llr_values(*(x.to_numpy(float) for x in (a, b, c, d)), smooth))

    return F.when((a + smooth > 0) & (b + smooth > 0) & (c + smooth > 0) & (d + smooth > 0), run(a, b, c, d))


def fisher_right_values(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Right tail of the hypergeometric distribution; 1 where the margins make none."""
    m, n, k = a + b, c + d, a + c
    total = m + n
    out = np.ones(len(a))
    ok = (m >= 0) & (n >= 0) & (k >= 0) & (k <= total) & (total > 0)
    low, high = np.maximum(0, k - n), np.minimum(m, k)
    ok &= low <= high
    rows = np.flatnonzero(ok)
    x = np.clip(a, low, high)
    start = np.zeros(len(a))
    if len(rows):
        def choose(p, q):
            return lgamma(p[rows] + 1) - lgamma(q[rows] + 1) - lgamma(p[rows] - q[rows] + 1)

        start[rows] = choose(m, x) + choose(n, k - x) - choose(total, k)
    for i in rows:
        steps = int(high[i] - x[i])
        j = x[i] + np.arange(steps)
        ratio = (m[i] - j) * (k[i] - j) / ((j + 1) * (n[i] - k[i] + j + 1))
        out[i] = min(1.0, math.exp(start[i]) * (1 + np.cumprod(ratio).sum()))
    return out


def fisher_right(a: Column, b: Column, c: Column, d: Column) -> Column:
    """p-value of Fisher's exact test, right-sided."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(fisher_right_values(*(x.to_numpy(float) for x in (a, b, c, d))))

    return run(a, b, c, d)
