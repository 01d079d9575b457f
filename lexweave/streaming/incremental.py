"""Association over growing text: counts of new documents are added up as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..corpus import Corpus
from ..functions.text import TextNorm
from ..operators.contingency import COUNTS, Contingency, checked, with_margins
from ..operators.kernel import Counter
from ..result import Result
from ..sources.readers import decoded, from_glob

SUMS = ("a", "b", "c", "d", "DocFrequency")


def stream_files(spark: SparkSession, folder: str, pattern: str = "*.txt", per_batch: int = 1000) -> DataFrame:
    """``doc_id, text, ts`` of the files of a folder, and of those that come later."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), decoded(F.col("content")).alias("text"), F.col("modificationTime").alias("ts"))


def running_counts(docs: DataFrame, nodes: Iterable[str], windowsize: int = 5, norm: TextNorm | None = None, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Sums of the counts of each document, by ``by``, Node and Collocate; for a batch or a stream (output modes ``complete`` and ``update``).

    The state is one row of sums a pair.  A stream needs no window over
    positions, since a document is counted within its row.
    """
    checked(windowsize, 1)
    corpus = Corpus(docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.lit(0)), norm, text)
    prepared, by = corpus.prepared(), list(by)
    types = "".join(f"`{x}` {prepared.schema[x].dataType.simpleString()}, " for x in by)
    rows = prepared.select(*by, "__text").mapInArrow(Counter(corpus.nodes(nodes), windowsize, 1, by), f"{types}Node string, Collocate string, {COUNTS}")
    return rows.groupBy(*by, "Node", "Collocate").agg(*[F.sum(x).alias(x) for x in SUMS])


def scored(counts: DataFrame, metrics: str | Sequence[str], windowsize: int, minfreq: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Scores of the sums so far."""
    table = Contingency(with_margins(counts.filter(F.col("a") >= minfreq)), [], windowsize, minfreq, list(by))
    return table.score(metrics, doc_frequency=True)


def start_stream(docs: DataFrame, nodes: Iterable[str], metrics: str | Sequence[str], checkpoint: str, sink: Callable[[DataFrame, int], None], windowsize: int = 5, minfreq: int = 5, norm: TextNorm | None = None, once: bool = True) -> StreamingQuery:
    """Give ``sink`` the scores so far after each batch; ``once``: work off what is there, then stop."""
    counts = running_counts(docs, nodes, windowsize, norm)
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(scored(df, metrics, windowsize, minfreq), i))
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(docs: DataFrame, nodes: Iterable[str], time: str = "ts", every: str = "1 day", late: str = "1 day", windowsize: int = 5, norm: TextNorm | None = None) -> DataFrame:
    """Counts by windows of event time, with a watermark; windows are closed, and their state dropped, ``late`` after their end."""
    corpus = Corpus(docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.lit(0)), norm)
    prepared = corpus.prepared()
    rows = prepared.select(F.col(time), "__text").mapInArrow(Counter(corpus.nodes(nodes), windowsize, 1, [time]), f"`{time}` timestamp, Node string, Collocate string, {COUNTS}")
    return rows.withWatermark(time, late).groupBy(F.window(time, every).alias("TimeWindow"), "Node", "Collocate").agg(*[F.sum(x).alias(x) for x in SUMS])


def stream_corpus_analysis(spark: SparkSession, file_pattern: str, node: str, metric: str = "PMI", windowsize: int = 5, minfreq: int = 5, norm: TextNorm | None = None) -> Result:
    """Scores over all files that match a pattern, in one batch plan: partitions are worked off one after another, so memory doesn't grow with the files."""
    return from_glob(spark, file_pattern, norm).analyze_node(node, metric, windowsize, minfreq)
