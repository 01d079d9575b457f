"""Small analyses over score tables: composites, significance, shared contexts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus
from .stats import frequencies

STARS = ((10.83, "***"), (6.63, "**"), (3.84, "*"))


def composite(scores: DataFrame, weights: Mapping[str, float], scale: str = "minmax", name: str = "Composite") -> DataFrame:
    """Weighted sum of measures, each scaled to [0, 1] (``minmax``) or by its largest value (``max``) within its node."""
    if scale not in ("minmax", "max"):
        raise ValueError(f"scale must be 'minmax' or 'max': {scale!r}")
    node = Window.partitionBy("Node")
    total = F.lit(0.0)
    for m, w in weights.items():
        x, high = F.col(m), F.max(m).over(node)
        low = F.min(m).over(node) if scale == "minmax" else F.lit(0.0)
        total = total + w * F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
    return scores.withColumn(name, total)


def significance(scores: DataFrame, least: int = 3) -> DataFrame:
    """``Votes`` of ChiSquare and LLR (> 10.83), Tscore and Zscore (|x| > 3.291), and ``Significant`` from ``least`` of them."""
    tests = [F.col("ChiSquare") > 10.83, F.col("LLR") > 10.83, F.abs("Tscore") > 3.291, F.abs("Zscore") > 3.291]
    votes = sum((t.cast("int") for t in tests), F.lit(0))
    return scores.withColumn("Votes", votes).withColumn("Significant", F.col("Votes") >= least)


def stars(score: Column) -> Column:
    """*, ** and *** at 3.84, 6.63 and 10.83."""
    out = F.when(score > STARS[0][0], STARS[0][1])
    for limit, mark in STARS[1:]:
        out = out.when(score > limit, mark)
    return out.otherwise("")


def bonferroni(scores: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """``AdjustedP`` (times the number of tests of the node, 1 at most) and ``Significant``."""
    n = F.count("*").over(Window.partitionBy("Node"))
    return scores.withColumn("AdjustedP", F.least(F.lit(1.0), F.col(p) * n)).withColumn("Significant", F.col("AdjustedP") < alpha)


def normalised_pmi(table: DataFrame) -> Column:
    """PMI over -ln P(x, y), for a contingency row."""
    a, n, m, k = (F.col(c).cast("double") for c in ("a", "Total", "m", "k"))
    ok = (a > 0) & (n > a) & (m > 0) & (k > 0)
    return F.when(ok, F.log(a * n / (m * k)) / -F.log(a / n))


def window_comparison(corpus: Corpus, node: str, metric: str, windows: Iterable[int], minfreq: int = 5) -> DataFrame:
    """``WindowSize, Node, Collocate, Frequency`` and the measure, for each window."""
    out = None
    for w in windows:
        part = corpus.contingency(node, w, minfreq).score(metric).select(F.lit(int(w)).alias("WindowSize"), "*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no window")
    return out


def shared_contexts(corpus: Corpus, nodes: Iterable[str], metric: str = "PPMI", windowsize: int = 5, minfreq: int = 5) -> DataFrame:
    """``Node1, Node2, Shared, Jaccard, Cosine`` of nodes by their collocates of positive score."""
    scores = corpus.contingency(nodes, windowsize, minfreq).score(metric).withColumn("s", F.col(metric)).filter("s > 0")
    size = scores.groupBy("Node").agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("len"))
    full = scores.join(F.broadcast(size), "Node")  # a row a node, which the caller lists
    x, y = full.alias("x"), full.alias("y")
    both = x.join(y, (F.col("x.Collocate") == F.col("y.Collocate")) & (F.col("x.Node") < F.col("y.Node")))
    got = both.groupBy(F.col("x.Node").alias("Node1"), F.col("y.Node").alias("Node2"), F.col("x.n").alias("n1"), F.col("y.n").alias("n2"), F.col("x.len").alias("l1"), F.col("y.len").alias("l2")).agg(F.count("*").alias("Shared"), F.sum(F.col("x.s") * F.col("y.s")).alias("dot"))
    return got.select("Node1", "Node2", "Shared", (F.col("Shared") / (F.col("n1") + F.col("n2") - F.col("Shared"))).alias("Jaccard"), (F.col("dot") / (F.col("l1") * F.col("l2"))).alias("Cosine"))


def features(corpus: Corpus, nodes: Iterable[str], metric: str = "PPMI", windowsize: int = 5, minfreq: int = 5, top_n: int = 20) -> DataFrame:
    """``Node, Features``: a map of the best collocates of each node to their scores."""
    best = corpus.contingency(nodes, windowsize, minfreq).top(metric, top_n)
    return best.groupBy("Node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("Collocate", metric)))).alias("Features"))


def filter_vocabulary(corpus: Corpus, min_frequency: int = 1, max_frequency: int | None = None) -> DataFrame:
    """``Token, Frequency, DocFrequency`` of tokens within the bounds."""
    freq = frequencies(corpus).filter(F.col("Frequency") >= min_frequency)
    return freq if max_frequency is None else freq.filter(F.col("Frequency") <= max_frequency)
