"""Comparison of the groups of a corpus, all groups in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus


@dataclass
class Subcorpora:
    """``scores`` (Group first), ``summary``, ``effects`` and ``parameters``."""

    scores: DataFrame
    summary: DataFrame
    effects: DataFrame
    parameters: DataFrame


def compare_subcorpora(corpus: Corpus, split_field: str, node: str, metric: str = "PMI", windowsize: int = 5, minfreq: int = 5, compat: bool = False) -> Subcorpora:
    """Scores of one node in each group; documents whose ``split_field`` is null are left out."""
    if split_field not in corpus.df.columns:
        raise ValueError(f"no column {split_field!r}")
    grouped = corpus.over(corpus.df.withColumn("Group", F.col(split_field).cast("string")).filter(F.col("Group").isNotNull()))
    table = grouped.contingency(node, windowsize, minfreq, by=["Group"])
    scores = table.score(metric, doc_frequency=True)
    groups = grouped.df.select("Group").distinct()
    had = scores.groupBy("Group").agg(F.count("*").alias("n"), F.avg(metric).alias("AvgScore"))
    summary = groups.join(had, "Group", "left").select(F.col("Group").alias("Subcorpus"), F.coalesce("n", F.lit(0)).cast("long").alias("NumCollocates"), "AvgScore")
    note = [("split_field", split_field), ("node", table.nodes[0]), ("metric", metric), ("windowsize", str(windowsize)), ("minfreq", str(minfreq))]
    return Subcorpora(scores, summary, effect_sizes(scores, metric, compat), corpus.spark.createDataFrame(note, "Parameter string, Value string"))


def effect_sizes(scores: DataFrame, metric: str, compat: bool = False) -> DataFrame:
    """``Collocate, Group1, Group2, Score1, Score2, Difference, CohensD, EffectSize`` of collocates that two groups share, Group1 < Group2.

    One score a group has no variance, so there is no effect size: null, or
    with ``compat`` 0.0 and its label.
    """
    sides = [scores.select("Node", "Collocate", F.col("Group").alias(f"Group{i}"), F.col(metric).alias(f"Score{i}")) for i in (1, 2)]
    both = sides[0].join(sides[1], ["Node", "Collocate"]).filter("Group1 < Group2")
    d = F.lit(0.0 if compat else None).cast("double")
    size = F.abs("CohensD")
    label = F.when(size < 0.2, "Small").when(size < 0.5, "Medium").when(size < 0.8, "Large").when(size >= 0.8, "Very Large")
    return both.select("Collocate", "Group1", "Group2", "Score1", "Score2", (F.col("Score1") - F.col("Score2")).alias("Difference"), d.alias("CohensD")).withColumn("EffectSize", label)
