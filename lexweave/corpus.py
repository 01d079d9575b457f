"""A corpus: documents in a DataFrame, and how their text is normalised."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.text import TextNorm
from .operators.contingency import Contingency, checked
from .result import Result


class Corpus:
    """Documents (``doc_id``, ``text`` and any other columns) under a :class:`TextNorm`.

    Nothing is computed before an action.  ``preprocess=False`` takes the text
    as it is and cuts it by character class.  A null text has no tokens; rows
    that share a doc_id are documents of their own.
    """

    def __init__(self, df: DataFrame, norm: TextNorm | None = None, text: str = "text", doc_id: str = "doc_id", preprocess: bool = True):
        for c in (text, doc_id):
            if c not in df.columns:
                raise ValueError(f"no column {c!r} in {df.columns}")
        self.df, self.norm, self.text, self.doc_id, self.preprocess = df, norm or TextNorm(), text, doc_id, preprocess

    @classmethod
    def from_df(cls, df: DataFrame, text_column: str = "text", metadata_columns: Sequence[str] | None = None, norm: TextNorm | None = None, doc_id: str | None = None, preprocess: bool = True) -> Corpus:
        """Only ``metadata_columns`` are kept beside the text, all if it is None.  Without ``doc_id`` rows are numbered."""
        if text_column not in df.columns:
            raise ValueError(f"no column {text_column!r} in {df.columns}")
        if doc_id is None:
            doc_id = "doc_id"
            if doc_id not in df.columns:
                df = df.withColumn(doc_id, F.monotonically_increasing_id())
        if metadata_columns is not None:
            df = df.select(doc_id, text_column, *[c for c in metadata_columns if c not in (doc_id, text_column)])
        return cls(df, norm, text_column, doc_id, preprocess)

    @classmethod
    def from_texts(cls, spark: SparkSession, texts: Sequence[str | None], norm: TextNorm | None = None, metadata: dict[str, Sequence[Any]] | None = None) -> Corpus:
        """A small corpus from Python strings, numbered from 1."""
        names = list(metadata or {})
        rows = [(i + 1, t, *[metadata[n][i] for n in names]) for i, t in enumerate(texts)] if metadata else [(i + 1, t) for i, t in enumerate(texts)]
        if rows and names:
            df = spark.createDataFrame(rows, ["doc_id", "text", *names])
        else:
            df = spark.createDataFrame(rows, "doc_id long, text string")
        return cls(df, norm)

    @classmethod
    def from_text(cls, spark: SparkSession, text: str, norm: TextNorm | None = None) -> Corpus:
        return cls.from_texts(spark, [text], norm)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def over(self, df: DataFrame) -> Corpus:
        """The same settings over other rows."""
        return Corpus(df, self.norm, self.text, self.doc_id, self.preprocess)

    def token_column(self) -> Column:
        if not self.preprocess:
            return T.raw_tokens(F.col(self.text))
        return T.split_tokens(T.normalised(F.col(self.text), self.norm))

    def with_tokens(self, name: str = "tokens") -> DataFrame:
        """All columns, and the tokens of each document."""
        return self.df.withColumn(name, F.coalesce(self.token_column(), F.array().cast("array<string>")))

    def prepared(self) -> DataFrame:
        """All columns, and ``__text``: the tokens joined by blanks.  Counting works on normalised text, whether ``preprocess`` is set or not."""
        plain = T.normalised(F.col(self.text), self.norm)
        if not self.norm.normalize_whitespace:
            plain = F.array_join(T.split_tokens(plain), " ")
        return self.df.withColumn("__text", plain)

    def joined(self) -> DataFrame:
        """All columns, and ``__text``: the tokens that :meth:`with_tokens` gives, joined by blanks."""
        if self.preprocess:
            return self.prepared()
        return self.df.withColumn("__text", F.array_join(self.token_column(), " "))

    def tokens(self) -> DataFrame:
        """``doc_id, pos, token``, positions from 0."""
        return self.with_tokens("__toks").select(self.doc_id, F.posexplode("__toks").alias("pos", "token"))

    def filter_length(self, min_length: int = 0, max_length: int | None = None) -> Corpus:
        """Documents of at least ``min_length`` and at most ``max_length`` tokens."""
        n = F.coalesce(F.size(self.token_column()), F.lit(0))
        keep = n >= min_length
        if max_length is not None:
            keep = keep & (n <= max_length)
        return self.over(self.df.filter(keep))

    def renormalize(self, norm: TextNorm | None = None, min_length: int = 0, max_length: int | None = None) -> Corpus:
        """The corpus under another normalisation, filtered by length."""
        other = Corpus(self.df, norm or self.norm, self.text, self.doc_id, True)
        return other.filter_length(min_length, max_length)

    def vocabulary(self) -> DataFrame:
        """``token, idx``: tokens numbered from 1 in order of their first occurrence."""
        first = self.tokens().groupBy("token").agg(F.min(F.struct(self.doc_id, "pos")).alias("first"))
        # one row a token: the global order is over the vocabulary, not the corpus
        return first.select("token", F.row_number().over(Window.orderBy("first")).cast("long").alias("idx"))

    def document_term_matrix(self) -> DataFrame:
        """``doc_id, token, tf`` of all pairs that occur, counted within each row."""
        counts = self.tokens().groupBy(self.doc_id, "token").agg(F.count("*").alias("tf"))
        return counts

    def nodes(self, nodes: str | Iterable[str]) -> list[str]:
        """Nodes in the form of the tokens, each once."""
        out = []
        for n in [nodes] if isinstance(nodes, str) else nodes:
            if not n or not n.strip():
                raise ValueError("a node is empty")
            normal = T.normalize_node(n, self.norm)
            if not normal:
                raise ValueError(f"node {n!r} is empty after normalisation")
            out.append(normal)
        return list(dict.fromkeys(out))

    def node_present(self, node: str) -> bool:
        """Whether the node occurs (runs a job that stops at the first document that has it)."""
        [n] = self.nodes(node)
        at = T.ngram_positions(self.token_column(), n)
        return not self.df.filter(F.size(at) > 0).select(self.doc_id).limit(1).isEmpty()

    def contingency(self, nodes: str | Iterable[str], windowsize: int = 5, minfreq: int = 5, by: Iterable[str] = ()) -> Contingency:
        """Counts of all nodes in one pass."""
        checked(windowsize, minfreq)
        return Contingency.count(self.prepared(), self.nodes(nodes), windowsize, minfreq, by, self.prune(self.nodes(nodes)).prepared())

    def prune(self, nodes: list[str], most: int = 8) -> Corpus:
        """Without documents that can't hold a node, where the raw text tells: a few nodes of plain letters."""
        n = self.norm
        telling = n.strip_case and not n.strip_accents and n.unicode_form in (None, "NFC") and (n.punctuation_to_space or not n.strip_punctuation) and (n.normalize_whitespace or not n.strip_whitespace)
        first = sorted({x.split()[0] for x in nodes})
        if not telling or not 0 < len(first) <= most or not all(w.isascii() and w.isalpha() for w in first):
            return self
        found = F.lit(False)
        for w in first:
            found = found | F.contains(F.lower(self.text), F.lit(w))
        return self.over(self.df.filter(found))

    def document_contingency(self, nodes: str | Iterable[str], windowsize: int = 5, minfreq: int = 3) -> Contingency:
        """Counts of each document by itself."""
        return Contingency.per_document(self.prepared(), self.nodes(nodes), windowsize, minfreq, self.doc_id)

    def score(self, metrics: str | Sequence[str], nodes: str | Iterable[str], windowsize: int = 5, minfreq: int = 5) -> Result:
        """Scores of all collocates, in no order."""
        table = self.contingency(nodes, windowsize, minfreq)
        return Result(table.score(metrics), _note(table, metrics))

    def analyze_node(self, node: str, metrics: str | Sequence[str], windowsize: int = 5, minfreq: int = 5, top_n: int | None = None) -> Result:
        """Scores with document frequencies, best first by the first measure."""
        return self.analyze_nodes([node], metrics, windowsize, minfreq, top_n)

    def analyze_nodes(self, nodes: Iterable[str], metrics: str | Sequence[str], windowsize: int = 5, minfreq: int = 5, top_n: int | None = 100, by: Iterable[str] = ()) -> Result:
        """The best collocates of each node (and group), all nodes in one plan."""
        table = self.contingency(nodes, windowsize, minfreq, by)
        ranked = table.top(metrics, top_n)
        return Result(ranked.orderBy(*table.by, "Node", "Rank").drop("Rank"), _note(table, metrics, top_n=top_n, analysis_type="nodes"))


def _note(table: Contingency, metrics: str | Sequence[str], **more: Any) -> dict[str, Any]:
    note: dict[str, Any] = {"node": table.nodes[0] if len(table.nodes) == 1 else table.nodes, "windowsize": table.windowsize, "minfreq": table.minfreq}
    note |= {"metric": metrics} if isinstance(metrics, str) else {"metrics": list(metrics)}
    return note | more


def score_text(spark: SparkSession, metrics: str | Sequence[str], text: str, node: str, windowsize: int = 5, minfreq: int = 5, norm: TextNorm | None = None) -> Result:
    """Scores within one text."""
    corpus = Corpus.from_text(spark, text, norm)
    table = corpus.document_contingency(node, windowsize, minfreq)
    scored = table.score(metrics)
    return Result(scored.drop(corpus.doc_id).orderBy("Collocate"), _note(table, metrics))
