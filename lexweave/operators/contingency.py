"""Contingency tables of the words around nodes, and their scores."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import Cells, resolve
from .kernel import Counter

COUNTS = "a long, b long, c long, d long, DocFrequency long"


def checked(window: int, minfreq: int) -> None:
    if window <= 0:
        raise ValueError(f"windowsize must be positive: {window}")
    if minfreq <= 0:
        raise ValueError(f"minfreq must be positive: {minfreq}")


def with_margins(df: DataFrame) -> DataFrame:
    """Margins and expected counts beside a, b, c, d; an expected count is 0 where ``Total`` is 0.

    ``Total`` is m + n; Spark's names don't tell case, so it can't be called N beside n.
    """
    df = df.withColumns({"m": F.col("a") + F.col("b"), "n": F.col("c") + F.col("d"), "k": F.col("a") + F.col("c"), "l": F.col("b") + F.col("d")})
    df = df.withColumn("Total", F.col("m") + F.col("n"))

    def expected(x: str, y: str) -> Column:
        return F.when(F.col("Total") == 0, F.lit(0.0)).otherwise(F.col(x).cast("double") * F.col(y).cast("double") / F.col("Total").cast("double"))

    return df.withColumns({"E11": expected("m", "k"), "E12": expected("m", "l"), "E21": expected("n", "k"), "E22": expected("n", "l")})


@dataclass
class Contingency:
    """Counts of one or more nodes: ``df`` has ``by``, Node, Collocate, a..d, margins, expected counts and DocFrequency.

    ``prepared`` (with the column ``__text``: tokens joined by blanks) is kept for the measures that need tokens;
    ``pruned`` may be the part of it that can hold a node.
    """

    df: DataFrame
    nodes: list[str]
    windowsize: int
    minfreq: int
    by: list[str]
    prepared: DataFrame | None = None
    pruned: DataFrame | None = None

    @classmethod
    def count(cls, prepared: DataFrame, nodes: Sequence[str], windowsize: int, minfreq: int, by: Iterable[str] = (), pruned: DataFrame | None = None) -> Contingency:
        """Counts summed over the documents in which the collocate stands near the node; a pair stays if a >= minfreq."""
        checked(windowsize, minfreq)
        nodes, by = list(dict.fromkeys(nodes)), list(by)
        counts = _counts(prepared if pruned is None else pruned, nodes, windowsize, 1, by, False)
        keys = [*by, "Node", "Collocate"]
        total = counts.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("a", "b", "c", "d", "DocFrequency")]).filter(F.col("a") >= minfreq)
        return cls(with_margins(total), nodes, windowsize, minfreq, by, prepared, pruned)

    @classmethod
    def per_document(cls, prepared: DataFrame, nodes: Sequence[str], windowsize: int, minfreq: int, doc_id: str) -> Contingency:
        """Counts of each document by itself; ``minfreq`` holds within the document."""
        checked(windowsize, minfreq)
        nodes = list(dict.fromkeys(nodes))
        return cls(with_margins(_counts(prepared, nodes, windowsize, minfreq, [doc_id], True)), nodes, windowsize, minfreq, [doc_id], prepared)

    @classmethod
    def from_df(cls, df: DataFrame, node: str, windowsize: int, minfreq: int) -> Contingency:
        """Wrap counts made elsewhere; what lacks is derived from a, b, c, d."""
        if "Node" not in df.columns:
            df = df.withColumn("Node", F.lit(node))
        if "E22" not in df.columns:
            df = with_margins(df)
        return cls(df, [node], windowsize, minfreq, [])

    @property
    def keys(self) -> list[str]:
        return [*self.by, "Node", "Collocate"]

    def score(self, metrics: str | Sequence[str], doc_frequency: bool = False, formula: str = "original") -> DataFrame:
        """``by``, Node, Collocate, Frequency, a column for each measure, and DocFrequency if wanted."""
        wanted = [resolve(m) for m in ([metrics] if isinstance(metrics, str) else metrics)]
        if not wanted:
            raise ValueError("no metric")
        df = self.df
        if any(m.needs_tokens for m in wanted):
            from .gravity import lexical_gravity

            df = df.join(lexical_gravity(self, formula), self.keys, "left")
        cells = Cells.of()
        columns = [(F.col("LexicalGravity") if m.needs_tokens else m.build(cells)).alias(m.name) for m in wanted]
        extra = [F.col("DocFrequency")] if doc_frequency and "DocFrequency" in df.columns else []
        return df.select(*self.keys, F.col("a").alias("Frequency"), *extra, *columns)

    def top(self, metrics: str | Sequence[str], top_n: int | None, doc_frequency: bool = True) -> DataFrame:
        """The best ``top_n`` collocates of each node (and group) by the first measure, ties by collocate; column ``Rank``."""
        names = [metrics] if isinstance(metrics, str) else list(metrics)
        scored = self.score(names, doc_frequency)
        order = Window.partitionBy(*self.by, "Node").orderBy(F.desc_nulls_last(resolve(names[0]).name), "Collocate")
        ranked = scored.withColumn("Rank", F.row_number().over(order))
        return ranked if top_n is None else ranked.filter(F.col("Rank") <= top_n)


def _counts(prepared: DataFrame, nodes: list[str], windowsize: int, minfreq: int, by: list[str], per_doc: bool) -> DataFrame:
    types = "".join(f"`{x}` {prepared.schema[x].dataType.simpleString()}, " for x in by)
    return prepared.select(*by, "__text").mapInArrow(Counter(nodes, windowsize, minfreq, by, per_doc), f"{types}Node string, Collocate string, {COUNTS}")
