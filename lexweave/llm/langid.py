"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle 1994).

A profile is a language's ``size`` most frequent character n-grams (n = 1 to 3,
within blank-padded words), most frequent first, ties by code point order.  A
document's own profile is compared with each by the out-of-place distance: for
each n-gram of the document the difference of the two ranks, or ``size`` if the
language lacks it.  The distance is divided by ``size`` times the number of the
document's n-grams, so it lies in [0, 1].

Profiles are learnt from labelled documents, ``per_language`` of each language
(a bound on the training rows; the first in order of md5(doc_id), then of the
text's hash, each row as often as it is among them).

Defined results: a text that is null, empty or without letters gets
``pred_lang`` null, ``distance`` 1.0 and ``rejected`` true.  Ties between
languages go to the first in alphabetical order.  Repeated rows are each
answered.  Other columns of the input are ignored (or, in
:func:`filter_language`, passed on).  An empty training table yields no
profiles, so every document is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import id_type
from ._text import slices

SIZE = 300
PER_LANGUAGE = 200
MAX_DISTANCE = 0.8


def normalise(texts: pa.Array) -> pa.Array:
    """Lower case; each run of anything but letters becomes one blank; a blank at both ends."""
    texts = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"\PL+", " ")
    blank = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(blank, pc.utf8_trim(texts, " "), blank, pa.scalar("", pa.large_string()))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of a normalised text (21 bits a code point, so numeric order is text order) and their counts."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = c == 32
    hi = c << np.uint64(42)
    two = hi[:-1] | c[1:] << np.uint64(21)
    three = (two[:-1] | c[2:])[~blank[1:-1]]
    return np.unique(np.concatenate([hi[~blank], two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, ties by key."""
    if len(keys) > size:  # keep everything that ties with the last place, then sort
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")][:size]


def train_profiles(docs: DataFrame, size: int = SIZE, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Profile of each language from ``per_language`` of its documents."""
    rows = docs.select(F.col("doc_id").alias("__id"), F.col(lang).alias("__lang"), F.col(text).alias("__text")).filter("__lang is not null and __text is not null and __id is not null")
    order = Window.partitionBy("__lang").orderBy("__o", "__id", "__h")
    keyed = rows.select("__id", "__lang", F.xxhash64("__text").alias("__h"), F.md5(F.col("__id").cast("string")).alias("__o"))
    wanted = keyed.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= per_language).groupBy("__id", "__lang", "__h").agg(F.count("*").alias("__times"))
    wanted = wanted.select(F.col("__id").alias("i"), F.col("__lang").alias("l"), F.col("__h").alias("h"), F.col("__times").alias("times"))
    # bounded by per_language; a row that is in the table more often than in the sample counts as often as in the sample
    found = rows.join(F.broadcast(wanted), (F.col("__id") == F.col("i")) & (F.col("__lang") == F.col("l")) & (F.xxhash64("__text") == F.col("h")))
    once = found.groupBy("__id", "__lang", "h").agg(F.first("__text").alias("__text"), F.first("times").alias("times"))
    sample = once.select("__lang", F.explode(F.array_repeat("__text", F.col("times").cast("int"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for language, t in zip(b.column(0).to_pylist(), normalise(b.column(1)).to_pylist(), strict=True):
                k, n = gram_counts(t)
                parts.append(pd.DataFrame({"lang": language, "key": k.astype(np.int64), "n": n}))
        if parts:
            yield pa.RecordBatch.from_pandas(pd.concat(parts).groupby(["lang", "key"], as_index=False)["n"].sum(), preserve_index=False)

    if wanted.isEmpty():
        return {}
    grams = sample.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    top = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).filter(F.col("rank") <= size)
    got = top.toPandas().sort_values(["lang", "rank"])
    return {str(k): g["key"].to_numpy(np.uint64) for k, g in got.groupby("lang")}


class Profiles:
    """Profiles laid out for fast comparison."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.names = sorted(profiles)
        self.size = size
        self.keys = np.unique(np.concatenate([profiles[n] for n in self.names])) if self.names else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.names), len(self.keys)), -1, np.int64)
        for i, n in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.keys, profiles[n])] = np.arange(len(profiles[n]))

    def of_ranked(self, mine: np.ndarray) -> np.ndarray | None:
        """Sum of rank differences to each language; None for a text without letters."""
        if not len(mine) or not self.names:
            return None
        at = np.searchsorted(self.keys, mine)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == mine)
        own = np.flatnonzero(known)
        theirs = self.ranks[:, at[own]]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - own))
        return apart.sum(axis=1) + self.size * (len(mine) - len(own))


def _classified(docs: DataFrame, profiles: dict[str, np.ndarray], size: int, max_distance: float, text: str, keep: bool) -> DataFrame:
    model = Profiles(profiles, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            names, dist = [], np.ones(b.num_rows)
            for i, t in enumerate(normalise(b.column(text)).to_pylist()):
                keys, counts = gram_counts(t)
                mine = ranked(keys, counts, model.size)
                d = model.of_ranked(mine)
                if d is None:
                    names.append(None)
                    continue
                best = int(np.argmin(d))
                names.append(model.names[best])
                dist[i] = d[best] / (model.size * len(mine))
            rejected = np.array([n is None for n in names]) | (dist > max_distance)
            if keep:
                yield b.filter(pa.array(~rejected))
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(dist), pa.array(rejected)], ["doc_id", "pred_lang", "distance", "rejected"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {id_type(docs)}, pred_lang string, distance double, rejected boolean")


def identify_language(docs: DataFrame, profiles: dict[str, np.ndarray] | None = None, size: int = SIZE, max_distance: float = MAX_DISTANCE, text: str = "text") -> DataFrame:
    """``doc_id, pred_lang, distance, rejected`` for each row of ``docs``."""
    return _classified(docs, train_profiles(docs, size, text=text) if profiles is None else profiles, size, max_distance, text, keep=False)


def filter_language(docs: DataFrame, profiles: dict[str, np.ndarray] | None = None, size: int = SIZE, max_distance: float = MAX_DISTANCE, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that resemble one of the languages, with all their columns."""
    return _classified(docs, train_profiles(docs, size, text=text) if profiles is None else profiles, size, max_distance, text, keep=True)
