"""Aggregates that Spark's own don't give for every input, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null where one side is constant, for which ``corr`` fails in ANSI mode."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def tidy(x: Column) -> Column:
    """Rounded to about nine digits, in steps that other engines do alike."""
    r = lambda s: F.floor(x * s + 0.5).cast("double") / s
    return F.when(F.abs(x) < 1e3, r(1e6)).when(F.abs(x) < 1e9, r(1e3)).when(F.abs(x) < 1e15, F.floor(x / 1e3 + 0.5).cast("double") * 1e3).otherwise(x)
