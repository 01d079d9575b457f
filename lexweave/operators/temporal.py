"""Association over time: all periods in one pass, trends over them, and comparisons of periods."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.agg import correlation


@dataclass
class Temporal:
    """``scores``: Period (from 1), PeriodLabel, Node, Collocate, Frequency, DocFrequency and the measure; ``trends`` if there are two periods."""

    scores: DataFrame
    trends: DataFrame
    periods: DataFrame
    metric: str


def time_value(column: Column, kind: str) -> Column:
    """Dates and timestamps as years, numbers as they are, strings by :func:`parse_time`."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.year(column).cast("double")
    if kind == "string":
        return parse_time(column)
    return column.cast("double")


def parse_time(text: Column) -> Column:
    """The year of a date written as 2020-12-31 or 31/12/2020, or the number; else null."""
    day = F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd/MM/yyyy"))
    return F.coalesce(F.year(day).cast("double"), F.try_to_number(text, F.lit("999999")).cast("double"))


def with_period(corpus: Corpus, time_field: str, time_bins: int) -> tuple[Corpus, DataFrame]:
    """The corpus with ``Period`` (1 to ``time_bins``; the last one closed), without documents that have no time; and the table of periods."""
    if time_bins <= 0:
        raise ValueError(f"time_bins must be positive: {time_bins}")
    if time_field not in corpus.df.columns:
        raise ValueError(f"no column {time_field!r}")
    kind = corpus.df.schema[time_field].dataType.typeName()
    if kind not in ("date", "timestamp", "timestamp_ntz", "string", "double", "float", "decimal", "byte", "short", "integer", "long"):
        raise ValueError(f"{time_field!r} is no time: {kind}")
    dated = corpus.df.withColumn("__t", time_value(F.col(time_field), kind)).filter("__t is not null")
    low, high = dated.agg(F.min("__t"), F.max("__t")).first()
    if low is None:
        raise ValueError(f"no document has a {time_field!r}")
    bins = 1 if low == high else time_bins
    width = (high - low) / bins
    period = F.lit(1) if bins == 1 else F.least(F.floor((F.col("__t") - low) / width).cast("int") + 1, F.lit(bins))
    edges = [low + i * width for i in range(bins + 1)]

    def name(x: float) -> str:
        return str(int(x)) if whole else f"{x:.1f}"

    rows = []
    for i in range(bins):
        whole = edges[i] == int(edges[i]) and edges[i + 1] == int(edges[i + 1])
        rows.append((i + 1, f"{name(edges[i])}-{name(edges[i + 1])}", edges[i], edges[i + 1]))
    periods = corpus.spark.createDataFrame(rows, "Period int, PeriodLabel string, PeriodStart double, PeriodEnd double")
    return corpus.over(dated.withColumn("Period", period).drop("__t")), periods


def analyze_temporal(corpus: Corpus, nodes: Iterable[str], time_field: str, metric: str = "PMI", time_bins: int = 5, windowsize: int = 5, minfreq: int = 5, top_n: int | None = 100) -> Temporal:
    """The best collocates of each node in each period, and their trends."""
    binned, periods = with_period(corpus, time_field, time_bins)
    table = binned.contingency(nodes, windowsize, minfreq, by=["Period"])
    scores = table.top(metric, top_n).drop("Rank").join(F.broadcast(periods.select("Period", "PeriodLabel")), "Period")  # one row a bin
    scores = scores.select("Period", "PeriodLabel", "Node", "Collocate", "Frequency", "DocFrequency", metric)
    return Temporal(scores, trends(scores, metric), periods, metric)


def trends(scores: DataFrame, metric: str) -> DataFrame:
    """``Node, Collocate, Correlation, Slope, MeanScore, StdScore, NumPeriods`` of pairs with two periods at least; time is the number of the period among those present."""
    pair = Window.partitionBy("Node", "Collocate").orderBy("Period")
    x = scores.withColumn("x", F.row_number().over(pair).cast("double")).withColumn("y", F.col(metric))
    got = x.groupBy("Node", "Collocate").agg(correlation("x", "y").alias("r"), F.regr_slope("y", "x").alias("s"), F.avg("y").alias("MeanScore"), F.stddev_samp("y").alias("sd"), F.count("*").alias("NumPeriods")).filter("NumPeriods > 1")
    flat = F.col("sd") < 1e-10
    return got.select("Node", "Collocate", F.when(flat, 0.0).otherwise(F.col("r")).alias("Correlation"), F.when(flat, 0.0).otherwise(F.col("s")).alias("Slope"), "MeanScore", F.when(flat, 0.0).otherwise(F.col("sd")).alias("StdScore"), "NumPeriods")


def emerging(trend: DataFrame, least: float = 0.5) -> DataFrame:
    return trend.filter(F.col("Correlation") > least).orderBy(F.desc("Slope"), "Node", "Collocate")


def declining(trend: DataFrame, most: float = -0.3) -> DataFrame:
    return trend.filter(F.col("Correlation") < most).orderBy("Slope", "Node", "Collocate")


def compare_periods(t: Temporal, first: int, second: int) -> DataFrame:
    """``Node, Collocate, Score1, Score2, Change, PercentChange`` of collocates of both periods."""
    sides = [t.scores.filter(F.col("Period") == p).select("Node", "Collocate", F.col(t.metric).alias(f"Score{i}")) for i, p in ((1, first), (2, second))]
    both = sides[0].join(sides[1], ["Node", "Collocate"])
    change = F.col("Score2") - F.col("Score1")
    return both.select("*", change.alias("Change"), F.when(F.col("Score1") != 0, 100.0 * change / F.abs("Score1")).alias("PercentChange"))


def time_series(t: Temporal, node: str, collocate: str) -> DataFrame:
    return t.scores.filter((F.col("Node") == node) & (F.col("Collocate") == collocate)).select("Period", "PeriodLabel", "Frequency", t.metric).orderBy("Period")


def bursts(t: Temporal, least: float = 2.0, periods: int = 3) -> DataFrame:
    """``Node, Collocate, Period, Score, Z``: the period with the highest z-score of a pair with ``periods`` periods at least, if above ``least``."""
    pair = Window.partitionBy("Node", "Collocate")
    s = F.col(t.metric)
    sd = F.stddev_samp(s).over(pair)
    z = t.scores.select("Node", "Collocate", "Period", s.alias("Score"), F.when(sd > 1e-10, (s - F.avg(s).over(pair)) / sd).alias("Z"), F.count("*").over(pair).alias("n")).filter(F.col("n") >= periods)
    best = Window.partitionBy("Node", "Collocate").orderBy(F.desc_nulls_last("Z"), "Period")
    return z.withColumn("i", F.row_number().over(best)).filter((F.col("i") == 1) & (F.col("Z") > least)).drop("i", "n")


def semantic_shift(t: Temporal, first: int, last: int) -> DataFrame:
    """``Node, Shift, Kept, Lost, Gained``: 1 - Jaccard of a node's collocates in two periods, and how many are in both or one."""
    side = t.scores.filter(F.col("Period").isin(first, last)).groupBy("Node", "Collocate").agg(F.max((F.col("Period") == first).cast("long")).alias("x"), F.max((F.col("Period") == last).cast("long")).alias("y"))
    got = side.groupBy("Node").agg(F.sum(F.col("x") * F.col("y")).alias("Kept"), F.sum(F.col("x") * (1 - F.col("y"))).alias("Lost"), F.sum(F.col("y") * (1 - F.col("x"))).alias("Gained"))
    return got.select("Node", (1.0 - F.col("Kept") / (F.col("Kept") + F.col("Lost") + F.col("Gained"))).alias("Shift"), "Kept", "Lost", "Gained")
