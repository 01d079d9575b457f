"""How measures agree on the ranking of the same collocates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agg import correlation
from ..result import metric_columns

BANDS = (("rare", 0, 5), ("mid", 6, 20), ("high", 21, None))


@dataclass
class MetricComparison:
    """The tables that were asked for; None where an early exit left one out."""

    scores: DataFrame
    rank_corr: DataFrame
    topk_overlap: DataFrame | None = None
    rank_diffs: DataFrame | None = None
    by_band_corr: DataFrame | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


def average_ranks(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``scores`` with ``r_<metric>``: rank from the best, ties share the mean.  The table of collocates is bounded by the vocabulary."""
    for m in metrics:
        order, peers = Window.orderBy(F.desc_nulls_last(m)), Window.partitionBy(m)
        scores = scores.withColumn(f"r_{m}", F.rank().over(order) + (F.count("*").over(peers) - 1) / 2.0)
    return scores


def _long(row: DataFrame, pairs: list[tuple[str, str]], names: Sequence[str]) -> DataFrame:
    """One row of columns c0, c1, ... as a row for each pair."""
    parts = [F.struct(F.lit(a).alias("Metric1"), F.lit(b).alias("Metric2"), *[F.col(f"{n}{i}").alias(n) for n in names]) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*parts)))


def spearman(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``Metric1, Metric2, Spearman`` of all pairs, each with itself too; null where a measure is constant."""
    pairs = list(combinations_with_replacement(metrics, 2))
    row = average_ranks(scores, metrics).agg(*[correlation(f"r_{a}", f"r_{b}").alias(f"Spearman{i}") for i, (a, b) in enumerate(pairs)])
    return _long(row, pairs, ["Spearman"])


def kendall(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``Metric1, Metric2, KendallTau`` (tau-b); compares all pairs of rows, so for tables of one node."""
    keyed = scores.select(F.row_number().over(Window.orderBy("Collocate")).alias("i"), *metrics)
    x, y = keyed.alias("x"), keyed.alias("y")
    signs = x.join(y, F.col("x.i") < F.col("y.i")).select(*[F.signum(F.col(f"x.{m}") - F.col(f"y.{m}")).alias(m) for m in metrics])
    pairs = list(combinations_with_replacement(metrics, 2))
    row = signs.agg(*[(F.sum(F.col(a) * F.col(b)) / F.nullif(F.sqrt(F.sum(F.abs(a)) * F.sum(F.abs(b))), F.lit(0.0))).alias(f"KendallTau{i}") for i, (a, b) in enumerate(pairs)])
    return _long(row, pairs, ["KendallTau"])


def top_k_overlap(scores: DataFrame, metrics: Sequence[str], ks: Sequence[int] = (10, 25, 50)) -> DataFrame:
    """``K, Pair, Overlap, Jaccard`` of the best K collocates; ties by collocate."""
    for m in metrics:
        scores = scores.withColumn(f"o_{m}", F.row_number().over(Window.orderBy(F.desc_nulls_last(m), "Collocate")))
    pairs = [(k, a, b) for k in ks for a, b in combinations(metrics, 2)]
    n = lambda x: F.sum(x.cast("long"))
    row = scores.agg(*[f for i, (k, a, b) in enumerate(pairs) for f in (n((F.col(f"o_{a}") <= k) & (F.col(f"o_{b}") <= k)).alias(f"both{i}"), n((F.col(f"o_{a}") <= k) | (F.col(f"o_{b}") <= k)).alias(f"any{i}"))])
    parts = [F.struct(F.lit(int(k)).alias("K"), F.lit(f"{a}-{b}").alias("Pair"), F.coalesce(F.col(f"both{i}"), F.lit(0)).alias("Overlap"), F.when(F.col(f"any{i}") > 0, F.col(f"both{i}") / F.col(f"any{i}")).otherwise(0.0).alias("Jaccard")) for i, (k, a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*parts)))


def rank_differences(scores: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """``Collocate, RankDiff, Metric1, Metric2``: rank by the first measure less that by the second."""
    r = average_ranks(scores, list(dict.fromkeys(pair)))
    return r.select("Collocate", (F.col(f"r_{pair[0]}") - F.col(f"r_{pair[1]}")).alias("RankDiff"), F.lit(pair[0]).alias("Metric1"), F.lit(pair[1]).alias("Metric2"))


def band_of(frequency: Column, bands: Sequence[tuple] = BANDS) -> Column:
    out = None
    for name, low, high in bands:
        test = frequency >= low if high is None else (frequency >= low) & (frequency <= high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def band_correlations(scores: DataFrame, metrics: Sequence[str], bands: Sequence[tuple] = BANDS) -> DataFrame:
    """``Band, Pair, Spearman, N``: correlation of the ranks in the whole table, within each band of frequency; null below two rows."""
    pairs = list(combinations(metrics, 2))
    r = average_ranks(scores, metrics).withColumn("Band", band_of(F.col("Frequency"), bands)).filter("Band is not null")
    row = r.groupBy("Band").agg(F.count("*").alias("N"), *[correlation(f"r_{a}", f"r_{b}").alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    parts = [F.struct(F.lit(f"{a}-{b}").alias("Pair"), F.when(F.col("N") >= 2, F.col(f"s{i}")).alias("Spearman")) for i, (a, b) in enumerate(pairs)]
    return row.select("Band", "N", F.inline(F.array(*parts))).select("Band", "Pair", "Spearman", "N")


def stratified_sample(scores: DataFrame, fraction: float, seed: int = 0, bands: Sequence[tuple] = BANDS) -> DataFrame:
    """A share of each band, one row at least, drawn without replacement by a hash of the collocate."""
    if not 0 < fraction <= 1:
        raise ValueError(f"fraction must be in (0, 1]: {fraction}")
    banded = scores.withColumn("__b", band_of(F.col("Frequency"), bands))
    by = Window.partitionBy("__b")
    n = F.greatest(F.lit(1), F.round(F.count("*").over(by) * fraction).cast("int"))
    i = F.row_number().over(by.orderBy(F.xxhash64("Collocate", F.lit(seed)), "Collocate"))
    return banded.withColumns({"__n": n, "__i": i}).filter("__i <= __n").drop("__b", "__n", "__i")


def compare_metrics(
    scores: DataFrame, metrics: Sequence[str] | None = None, ks: Sequence[int] = (10, 25, 50), diagnostics: Sequence[str] = ("corr", "topk", "deltas", "bands"),
    delta_pair: tuple[str, str] | None = None, bands: Sequence[tuple] = BANDS, early_exit_threshold: float = 0.95, sample_fraction: float = 1.0, seed: int = 0, tau: bool = False,
) -> MetricComparison:
    """Rank correlations and, unless all measures agree (the least Spearman reaches ``early_exit_threshold``), the other diagnostics."""
    metrics = list(metrics or metric_columns(scores))
    if len(metrics) < 2:
        raise ValueError("two measures are needed")
    if missing := [m for m in metrics if m not in scores.columns]:
        raise ValueError(f"no columns {missing}")
    if sample_fraction < 1:
        scores = stratified_sample(scores, sample_fraction, seed, bands)
    corr = spearman(scores, metrics)
    least = corr.filter("Metric1 <> Metric2").agg(F.min("Spearman")).first()[0]
    if tau:
        corr = corr.join(kendall(scores, metrics), ["Metric1", "Metric2"], "outer")
    out = MetricComparison(scores, corr, metadata={"metrics": metrics, "early_exit": least is not None and least >= early_exit_threshold, "min_spearman": least})
    if out.metadata["early_exit"]:
        return out
    if "topk" in diagnostics:
        out.topk_overlap = top_k_overlap(scores, metrics, ks)
    if "deltas" in diagnostics:
        out.rank_diffs = rank_differences(scores, delta_pair or (metrics[0], metrics[1]))
    if "bands" in diagnostics:
        out.by_band_corr = band_correlations(scores, metrics, bands)
    return out
