"""Corpus statistics.  Tokens are summed to a frequency table first; rankings run over that, not over the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import Corpus

COVERAGES = (25, 50, 75, 90, 95, 99, 100)


def frequencies(corpus: Corpus) -> DataFrame:
    """``Token, Frequency, DocFrequency``: how often, and in how many rows of the corpus.

    A row gives each of its tokens, and each different one once more for the
    document; both are summed in one pass with one exchange by token.
    """
    once = "transform(array_distinct(__toks), w -> named_struct('Token', w, 'n', 0L, 'df', 1L))"
    each = "transform(__toks, w -> named_struct('Token', w, 'n', 1L, 'df', 0L))"
    rows = corpus.with_tokens("__toks").select(F.expr(f"inline(concat({once}, {each}))"))
    return rows.groupBy("Token").agg(F.sum("n").alias("Frequency"), F.sum("df").alias("DocFrequency"))


def token_distribution(corpus: Corpus) -> DataFrame:
    """``Token, Frequency, DocFrequency, DocFrequencyRatio, RelativeFrequency, IDF, TFIDF``."""
    freq = frequencies(corpus)
    total = freq.agg(F.sum("Frequency").cast("double").alias("__n"))
    docs = corpus.df.agg(F.count("*").cast("double").alias("__d"))
    f, df = F.col("Frequency").cast("double"), F.col("DocFrequency").cast("double")
    idf = F.log(F.col("__d") / df)
    rows = freq.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(docs))  # one row each
    return rows.select("Token", "Frequency", "DocFrequency", (df / F.col("__d")).alias("DocFrequencyRatio"), (f / F.col("__n")).alias("RelativeFrequency"), idf.alias("IDF"), (f * idf).alias("TFIDF"))


def text_token_distribution(corpus: Corpus) -> DataFrame:
    """``Token, Frequency, RelativeFrequency``."""
    return token_distribution(corpus).select("Token", "Frequency", "RelativeFrequency")


def ranked(freq: DataFrame) -> DataFrame:
    """``Frequency, n_types, n_before, tokens_before``: one row for each different frequency, the most frequent first.

    The types of one frequency are alike for coverage and rank, so only the
    different frequencies are put in a global order, and there are few.
    """
    by = freq.groupBy("Frequency").agg(F.count("*").alias("n_types"))
    before = Window.orderBy(F.desc("Frequency")).rowsBetween(Window.unboundedPreceding, -1)
    return by.select("Frequency", "n_types", F.coalesce(F.sum("n_types").over(before), F.lit(0)).cast("long").alias("n_before"), F.coalesce(F.sum(F.col("Frequency") * F.col("n_types")).over(before), F.lit(0)).cast("long").alias("tokens_before"))


def vocab_coverage(corpus: Corpus, percentiles: Sequence[float] | None = None) -> DataFrame:
    """``Percentile, WordsNeeded, ProportionOfVocab, CumulativeTokens``: how many of the most frequent words make up each share of the tokens."""
    percentiles = [i / 100 for i in range(1, 101)] if percentiles is None else list(percentiles)
    return coverage(ranked(frequencies(corpus)), percentiles)


def coverage(steps: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    spark = steps.sparkSession
    p = spark.createDataFrame([(float(x),) for x in percentiles], "Percentile double")
    total = steps.agg(F.sum("n_types").alias("__types"), F.sum(F.col("Frequency") * F.col("n_types")).alias("__tokens"))
    goal = F.ceil(F.round(F.col("Percentile") * F.col("__tokens"), 6)).cast("long")
    asked = p.crossJoin(F.broadcast(total)).select("*", F.greatest(goal, F.lit(1)).alias("__goal"))
    reach = steps.select("*", (F.col("tokens_before") + F.col("Frequency") * F.col("n_types")).alias("__upto"))
    hit = asked.join(reach, (F.col("__goal") > F.col("tokens_before")) & (F.col("__goal") <= F.col("__upto")), "left")
    words = F.coalesce(F.col("n_before") + F.ceil((F.col("__goal") - F.col("tokens_before")) / F.col("Frequency")), F.col("__types"), F.lit(0)).cast("long")
    tokens = F.coalesce(F.col("tokens_before") + (words - F.col("n_before")) * F.col("Frequency"), F.col("__tokens"), F.lit(0)).cast("long")
    share = F.when(F.col("__types") > 0, words.cast("double") / F.col("__types")).otherwise(0.0)
    return hit.select("Percentile", words.alias("WordsNeeded"), share.alias("ProportionOfVocab"), tokens.alias("CumulativeTokens"))


def corpus_stats(corpus: Corpus, strip_accents: bool = True) -> DataFrame:
    """One row of figures; accents are stripped first unless ``strip_accents`` is false.  An empty corpus has zeros and nulls."""
    if strip_accents and not corpus.norm.strip_accents:
        corpus = Corpus(corpus.df, corpus.norm.with_(strip_accents=True), corpus.text, corpus.doc_id, corpus.preprocess)
    n = F.size("__toks").cast("long")
    lengths = corpus.with_tokens("__toks").select(n.alias("n"))
    docs = lengths.agg(
        F.count("*").alias("num_documents"), F.avg("n").alias("avg_doc_length"), F.median("n").alias("median_doc_length"), F.min("n").alias("min_doc_length"), F.max("n").alias("max_doc_length"), F.stddev_samp("n").alias("std_doc_length"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens")
    )
    freq = frequencies(corpus)
    steps = ranked(freq)
    types = freq.agg(F.count("*").alias("vocabulary_size"), F.coalesce(F.sum((F.col("Frequency") == 1).cast("long")), F.lit(0)).alias("hapax_count"), F.avg("Frequency").alias("mean_type_frequency"), F.median("Frequency").alias("median_type_frequency"), F.max("Frequency").alias("max_type_frequency"), F.min("Frequency").alias("min_type_frequency"))
    needed = coverage(steps, [p / 100 for p in COVERAGES]).groupBy().agg(*[F.max(F.when(F.col("Percentile") == p / 100, F.col("WordsNeeded"))).alias(f"words_for_{p}") for p in COVERAGES])
    top = freq.orderBy(F.desc("Frequency"), "Token").limit(1000)
    rank = F.row_number().over(Window.orderBy(F.desc("Frequency"), "Token"))  # of 1000 rows
    logs = top.select(F.log(F.col("Frequency").cast("double")).alias("y"), F.log(rank.cast("double")).alias("x"))
    zipf = logs.agg(F.when(F.count("*") > 10, F.abs(F.regr_slope("y", "x"))).alias("zipf_exponent"))
    row = docs.crossJoin(types).crossJoin(needed).crossJoin(zipf)  # one row each
    v, t = F.col("vocabulary_size").cast("double"), F.col("total_tokens").cast("double")
    ttr = F.when(t > 0, v / t).otherwise(0.0)
    return row.select("*", ttr.alias("type_token_ratio"), (ttr * F.sqrt(t)).alias("root_ttr"), F.when(v > 0, F.col("hapax_count") / v).otherwise(0.0).alias("hapax_ratio"), *[F.when(v > 0, F.col(f"words_for_{p}") / v).otherwise(0.0).alias(f"coverage_ratio_{p}") for p in COVERAGES])


def coverage_summary(stats: DataFrame) -> str:
    """The one row of :func:`corpus_stats` as text."""
    r = stats.first().asDict()
    lines = [f"Documents: {r['num_documents']}, tokens: {r['total_tokens']}, types: {r['vocabulary_size']}"]
    lines += [f"{p:3d} % of the tokens: {r[f'words_for_{p}']} words ({100 * r[f'coverage_ratio_{p}']:.2f} % of the vocabulary)" for p in COVERAGES]
    return "\n".join(lines)
