"""Keywords of a corpus by TF-IDF, TextRank or RAKE."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.text import for_stopwords, stopwords
from ..session import written
from .kernel import Tokens, batches_of
from .pairs import blocks, both_ways
from .stats import frequencies

METHODS = ("tfidf", "textrank", "rake")
BLOCK_BYTES = 4 << 20


def keyterms(corpus: Corpus, method: str = "tfidf", num_keywords: int | None = 50, min_doc_freq: int = 3, max_doc_freq_ratio: float = 0.5, language: str | None = None, stop: Sequence[str] | None = None) -> DataFrame:
    """The best ``num_keywords`` keywords, ties by keyword (all if it is None, in no order).  ``stop`` takes the place of the language's stopwords."""
    if method == "tfidf":
        return tfidf(corpus, num_keywords, min_doc_freq, max_doc_freq_ratio, language, stop)
    if method == "textrank":
        return textrank(corpus, num_keywords, language, stop)
    if method == "rake":
        return rake(corpus, num_keywords, language or "english", stop)
    raise ValueError(f"method must be one of {METHODS}: {method!r}")


def _stop(language: str | None, stop: Sequence[str] | None) -> list[str]:
    return sorted({s.lower() for s in stop}) if stop is not None else stopwords(language)


def _best(df: DataFrame, score: str, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(F.desc(score), "Keyword").limit(n)


def tfidf(corpus: Corpus, num_keywords: int | None = 50, min_doc_freq: int = 3, max_doc_freq_ratio: float = 0.5, language: str | None = None, stop: Sequence[str] | None = None) -> DataFrame:
    """``Keyword, TFIDF, DocFreq, DocFreqRatio``: mean term frequency times ln(documents / document frequency)."""
    words = _stop(language, stop)
    docs = corpus.df.agg(F.count("*").cast("double").alias("__d"))
    freq = frequencies(corpus).crossJoin(F.broadcast(docs))  # one row
    if words:
        freq = freq.filter(~for_stopwords(F.col("Token"), language).isin(words))
    df = F.col("DocFrequency").cast("double")
    kept = freq.filter((F.col("DocFrequency") >= min_doc_freq) & (df <= F.col("__d") * max_doc_freq_ratio))
    score = F.col("Frequency").cast("double") / F.col("__d") * F.log(F.col("__d") / df)
    return _best(kept.select(F.col("Token").alias("Keyword"), score.alias("TFIDF"), F.col("DocFrequency").alias("DocFreq"), (df / F.col("__d")).alias("DocFreqRatio")), "TFIDF", num_keywords)


def word_pairs(corpus: Corpus, window: int = 5, language: str | None = None, stop: Sequence[str] | None = None) -> DataFrame:
    """``x, y, n``: the weight of each pair of words within ``window`` of each other once stopwords are out, both ways; a word paired with itself counts double."""
    words = _stop(language, stop)
    return blocks(corpus.joined(), window, False, words).mapInArrow(both_ways, "x string, y string, n long")


def textrank(corpus: Corpus, num_keywords: int | None = 50, language: str | None = None, stop: Sequence[str] | None = None, window: int = 5, damping: float = 0.85, most: int = 100, close: float = 1e-4) -> DataFrame:
    """``Keyword, TextRankScore, Frequency, DocFrequency``.

    Power iteration over the word graph, as joins: the scores are written after
    each round, so the plan stays short and no round is run twice.  A word
    without neighbours spreads its score evenly.
    """
    words = _stop(language, stop)
    freq = frequencies(corpus)
    if words:
        freq = freq.filter(~F.lower("Token").isin(words))
    freq = written(freq)
    v = freq.count()
    if v == 0:
        return freq.select(F.col("Token").alias("Keyword"), F.lit(0.0).alias("TextRankScore"), "Frequency", "DocFrequency")
    pairs = written(word_pairs(corpus, window, language, stop))
    sums = pairs.groupBy("x").agg(F.sum("n").alias("all"))
    edges = written(pairs.join(sums, "x").select("x", "y", (F.col("n") / F.col("all")).alias("p")))
    linked = sums.select("x", F.lit(True).alias("linked"))
    scores = written(freq.select(F.col("Token").alias("x")).join(linked, "x", "left").select("x", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / v).alias("s")))
    for _ in range(most):
        lone = scores.filter("not linked").agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]
        flow = edges.join(scores.select("x", "s"), "x").groupBy("y").agg(F.sum(F.col("p") * F.col("s")).alias("flow"))
        new = scores.join(flow, F.col("x") == F.col("y"), "left").select("x", "linked", F.col("s").alias("old"), (F.lit((1 - damping) / v) + damping * (F.coalesce("flow", F.lit(0.0)) + lone / v)).alias("s"))
        new = written(new)
        change, total = new.agg(F.max(F.abs(F.col("s") - F.col("old"))), F.sum("s")).first()
        if change < close:
            scores = new
            break
        scores = new.select("x", "linked", (F.col("s") / total).alias("s"))
    out = freq.join(scores, F.col("Token") == F.col("x")).select(F.col("Token").alias("Keyword"), F.col("s").alias("TextRankScore"), "Frequency", "DocFrequency")
    return _best(out, "TextRankScore", num_keywords)


class Phrases:
    """``mapInArrow`` function: texts to rows p, n, d: maximal runs of tokens that are no stopwords and longer than a character, how often, and in how many rows."""

    def __init__(self, stop: Sequence[str]):
        self.stop = frozenset(stop)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "__text"):
            t = Tokens(b.column("__text"))
            if not len(t.codes):
                continue
            keep = np.fromiter((len(w) > 1 and w.lower() not in self.stop for w in t.words.to_pylist()), bool, t.n_words)[t.codes]
            doc = np.repeat(np.arange(t.n_docs), np.diff(t.off))
            at, doc = np.flatnonzero(keep), doc[keep]
            if not len(at):
                continue
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc) > 0)]))
            off = pa.array(np.append(first, len(at)), pa.int32())
            coded = pc.binary_join(pa.ListArray.from_arrays(off, t.words.take(pa.array(t.codes[at])).cast(pa.string())), " ").dictionary_encode()
            code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            once = np.unique(doc[first] * size + code) % size
            yield pa.RecordBatch.from_arrays([coded.dictionary, *[pa.array(np.bincount(x, minlength=size)) for x in (code, once)]], ["p", "n", "d"])


def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows p, n, d to rows block, p, n, d: some megabytes of phrases as one row of lists."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for b in batches_of(batches, "p", BLOCK_BYTES):
        lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)) for c in ("p", "n", "d")]
        yield pa.RecordBatch.from_arrays([pa.array([block]), *lists], ["block", "p", "n", "d"])
        block += 1


def _of_block(p: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all phrases, and where each phrase begins among them."""
    lists = pc.split_pattern(p.cast(pa.large_string()), " ")
    off = np.asarray(lists.offsets)
    return lists.flatten().dictionary_encode(), off - off[0]


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to rows block, w, f, fl: for each word of the block how often it occurs in phrases, and the same times their lengths."""
    for b in batches:
        for i in range(b.num_rows):
            words, off = _of_block(b.column("p")[i].values)
            n, size = b.column("n")[i].values.to_numpy(zero_copy_only=False), np.diff(off)
            code, v = words.indices.to_numpy(zero_copy_only=False), len(words.dictionary)
            f, fl = np.zeros(v, np.int64), np.zeros(v, np.int64)
            np.add.at(f, code, np.repeat(n, size))
            np.add.at(fl, code, np.repeat(n * size, size))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(v, b.column("block")[i].as_py())), words.dictionary.cast(pa.string()), pa.array(f), pa.array(fl)], ["block", "w", "f", "fl"])


def phrase_scores(block: pa.Table, scores: pa.Table) -> pa.Table:
    """``Keyword, RAKEScore, Frequency, WordCount, DocFrequency`` of a block, by the scores of its words, added in their order."""
    p, n, d = (block.column(c).combine_chunks()[0].values for c in ("p", "n", "d"))
    words, off = _of_block(p)
    at = pc.index_in(words.dictionary, scores.column("w").combine_chunks().cast(pa.large_string()))
    s = scores.column("s").to_numpy()[at.to_numpy(zero_copy_only=False)][words.indices.to_numpy(zero_copy_only=False)]
    return pa.Table.from_arrays([p, pa.array(np.bincount(np.repeat(np.arange(len(p)), np.diff(off)), s)), n, pa.array(np.diff(off), pa.int64()), d], ["Keyword", "RAKEScore", "Frequency", "WordCount", "DocFrequency"])


def rake(corpus: Corpus, num_keywords: int | None = 50, language: str = "english", stop: Sequence[str] | None = None) -> DataFrame:
    """``Keyword, RAKEScore, Frequency, WordCount, DocFrequency``: a phrase scores the sum, over its words, of the mean length of the phrases they stand in.

    A phrase never travels with each of its words: phrases are written in
    blocks, and a block is sent the scores of its different words.
    """
    found = corpus.joined().select("__text").mapInArrow(Phrases(_stop(language, stop)), "p string, n long, d long")
    counts = found.groupBy("p").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    blocks_of = written(counts.mapInArrow(bundled, "block long, p array<string>, n array<long>, d array<long>"))
    words = blocks_of.mapInArrow(lengths, "block long, w string, f long, fl long")
    word = Window.partitionBy("w")
    scores = words.select("block", "w", (F.sum("fl").over(word).cast("double") / F.sum("f").over(word)).alias("s"))
    out = blocks_of.groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(phrase_scores, "Keyword string, RAKEScore double, Frequency long, WordCount long, DocFrequency long")
    return _best(out, "RAKEScore", num_keywords)
