"""Corpora from directories, CSV, JSON and globs, in whatever encoding the text has."""

from __future__ import annotations

import codecs
import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.text import TextNorm
from ..result import Result

BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
FALLBACKS = ("utf-8", "windows-1253", "iso8859-7")


def decode_bytes(raw: bytes) -> str:
    """By byte order mark, else UTF-8, else Greek code pages, else UTF-8 with replacements."""
    for mark, name in BOMS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    for name in FALLBACKS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


def decoded(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else decode_bytes(bytes(x)))

    return run(content)


def read_text_files(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.txt") -> DataFrame:
    """``doc_id, text, source`` of the files of a directory, numbered in order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    text = files.select(F.col("path").alias("source"), decoded(F.col("content")).alias("text"))
    return text.select(F.xxhash64("source").alias("doc_id"), "text", "source")


def read_corpus(
    spark: SparkSession, path: str, text_column: str = "text", metadata_columns: Sequence[str] | None = None, preprocess: bool = True, norm: TextNorm | None = None,
    min_doc_length: int = 10, max_doc_length: int | None = None, doc_id: str | None = None,
) -> Corpus:
    """A directory of ``.txt`` files, a ``.csv`` or ``.tsv``, a ``.json`` (an array of objects) or a Parquet table; documents outside the bounds of length are left out."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix in (".csv", ".tsv"):
        df = spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"', sep="\t" if suffix == ".tsv" else ",")
    elif suffix == ".json":
        df = spark.read.json(path, multiLine=True)
        if text_column in df.columns:
            df = df.filter(F.col(text_column).isNotNull() & (F.col(text_column) != ""))
    elif suffix in (".jsonl", ".ndjson"):
        df = spark.read.json(path)
    elif suffix == ".parquet":
        df = spark.read.parquet(path)
    elif suffix == "":
        df, text_column = read_text_files(spark, path), "text"
    else:
        raise ValueError(f"unsupported format {suffix!r}")
    corpus = Corpus.from_df(df, text_column, metadata_columns, norm, doc_id, preprocess)
    return corpus.filter_length(min_doc_length, max_doc_length)


def from_file(spark: SparkSession, path: str, norm: TextNorm | None = None) -> Corpus:
    """One file as one document."""
    files = spark.read.format("binaryFile").load(path)
    return Corpus(files.select(F.lit(1).cast("long").alias("doc_id"), decoded(F.col("content")).alias("text")), norm)


def from_dir(spark: SparkSession, path: str, norm: TextNorm | None = None) -> Corpus:
    """All ``.txt`` files below a directory, one document each."""
    return Corpus(read_text_files(spark, path, recursive=True), norm)


def from_glob(spark: SparkSession, pattern: str, norm: TextNorm | None = None) -> Corpus:
    """The files that match a pattern, one document each."""
    files = spark.read.format("binaryFile").load(pattern)
    return Corpus(files.select(F.xxhash64("path").alias("doc_id"), decoded(F.col("content")).alias("text"), F.col("path").alias("source")), norm)


def read_nodes(spark: SparkSession, path: str) -> list[str]:
    """A list of nodes, one a line; blank lines are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("n")).filter("n <> ''")
    return list(dict.fromkeys(r["n"] for r in lines.collect()))


def load_with_metadata(spark: SparkSession, path: str, format: str = "csv") -> Result:
    """What :func:`lexweave.sources.writers.export_with_metadata` wrote."""
    if format == "csv":
        meta: dict[str, Any] = {}
        with open(path, encoding="utf-8") as f:
            for line in f:
                if not line.startswith("#"):
                    break
                key, _, value = line[1:].partition(":")
                meta[key.strip()] = _value(value.strip())
        return Result(spark.read.csv(path, header=True, inferSchema=True, comment="#", multiLine=True, escape='"'), meta)
    if format == "json":
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        table = spark.read.json(path, multiLine=True).select(F.inline("data")) if whole["data"] else spark.createDataFrame([], "Node string")
        return Result(table.select(*whole["columns"]) if whole.get("columns") and whole["data"] else table, whole["metadata"])
    raise ValueError(f"format must be 'csv' or 'json': {format!r}")


def _value(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text
