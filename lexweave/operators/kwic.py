"""Keyword in context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.text import ngram_length, ngram_positions


@dataclass
class Concordance:
    """``lines``: LeftContext, Node, RightContext, DocId, Position (from 1); ``statistics``: one row over all documents, whatever the limit on lines."""

    node: str
    lines: DataFrame
    statistics: DataFrame

    def show(self, n: int = 20) -> None:
        self.lines.show(n, truncate=False)
        self.statistics.show(truncate=False)


def kwic(corpus: Corpus, node: str, context_size: int = 50, max_lines: int | None = 1000) -> Concordance:
    """All matches of a node (they may overlap) with ``context_size`` tokens on each side, the first ``max_lines`` in order of document and position."""
    if context_size < 0:
        raise ValueError(f"context_size must not be negative: {context_size}")
    [n] = corpus.nodes(node)
    width = ngram_length(n)
    pruned = corpus.prune([n]) if corpus.preprocess else corpus
    found = pruned.with_tokens("__toks").select(F.col(corpus.doc_id).alias("DocId"), "__toks", ngram_positions(F.col("__toks"), n).alias("at")).filter(F.size("at") > 0)
    p = F.col("p")
    left = F.slice("__toks", F.greatest(p - context_size, F.lit(0)) + 1, F.least(p, F.lit(context_size)))
    lines = found.select("DocId", "__toks", F.explode("at").alias("p")).select(F.array_join(left, " ").alias("LeftContext"), F.lit(n).alias("Node"), F.array_join(F.slice("__toks", p + width + 1, F.lit(context_size)), " ").alias("RightContext"), "DocId", (p + 1).cast("long").alias("Position"))
    counted = found.agg(F.coalesce(F.sum(F.size("at").cast("long")), F.lit(0)).alias("total_occurrences"), F.count("*").alias("documents_with_node"))
    total = F.col("total_occurrences")
    shown = total if max_lines is None else F.least(total, F.lit(max_lines).cast("long"))
    stats = counted.select("*", shown.alias("lines_generated"), (shown < total).alias("truncated"), F.lit(width).cast("long").alias("ngram_length"), F.lit(context_size).cast("long").alias("context_size"))
    ordered = lines.orderBy("DocId", "Position")
    return Concordance(n, ordered if max_lines is None else ordered.limit(max_lines), stats)
