"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents get copies = target share * budget / size of the source,
each the same number.  Its whole part is given to each; the fractional parts
are rounded by the pivotal method (Deville and Tille 1998): two documents with
fractions a and b fight, and at random one takes as much of the other's mass as
leaves one of them at exactly 0 or 1, in such a way that each keeps its
expectation.  Every partition pairs its own documents, source by source, and is
left with at most one undecided document a source; these residuals are paired
in groups of ``fan_in`` partitions, then groups of groups, and at the root
across sources.  So every document is rounded up with exactly its fractional
probability while the number of copies of a source in a partition, and in all,
is off by less than one from its expectation below the root.

The target share of a source is its size to the power ``alpha``, normalised,
unless ``targets`` (source, weight) are given; the budget is ``epochs`` times the
whole size.  Random numbers are drawn from (seed, doc_id), so a task run again
decides the same.

A doc_id may be of any type: what is rounded are numbers of 64 bits, the doc_id
itself where it is an integer, else its hash (ids of equal hash are one document).

Defined results: rows that share a doc_id are one document (sizes added, the
least source); null doc_ids are one document; a null source is a source of its
own; null or negative sizes count as 0, and a source of size 0 keeps one copy
of each document; a source without a target gets none.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._spark import free_name, id_type, partitions, written
from ._text import mix

ALPHA, EPOCHS, FAN_IN, SEED = 0.7, 1.0, 64, 20
EPS = 1e-9
_STATE = "doc_id long, source string, whole long, mass double, part int, done boolean"


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each id."""
    x = mix(ids.astype(np.int64).view(np.uint64) ^ mix(np.full(1, seed + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def fight(a: float, b: float, u: float) -> tuple[float, float]:
    """Masses of two documents after their fight; at least one of them is 0 or 1."""
    s = a + b
    if s < 1:
        return (0.0, s) if u * s < b else (s, 0.0)
    return (1.0, s - 1) if u * (2 - s) < 1 - b else (s - 1, 1.0)


def pivot(mass: np.ndarray, u: np.ndarray) -> int:
    """Round ``mass`` in place, in order; the index of what stays undecided, or -1."""
    held = -1
    for i in range(len(mass)):
        m = mass[i]
        if m < EPS or m > 1 - EPS:
            mass[i] = 0.0 if m < EPS else 1.0
        elif held < 0:
            held = i
        else:
            x, y = fight(mass[held], m, u[i])
            open_x, open_y = EPS < x < 1 - EPS, EPS < y < 1 - EPS
            mass[held], mass[i] = x if open_x else round(x), y if open_y else round(y)
            held = held if open_x else i if open_y else -1
    return held


def _round(seed: int, by_source: bool):
    """Rounds the rows of each run of equal (part, source) of a sorted partition; its residual stays not done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the undecided row of the present run: its key, mass and other columns
        for b in batches:
            ids = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            mass = b.column("mass").to_numpy(zero_copy_only=False).copy()
            part, source = b.column("part").to_pylist(), b.column("source").to_pylist()
            keys = list(zip(part, source, strict=True)) if by_source else part
            u = uniform(ids, seed)
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            extra = []
            open_at = np.zeros(len(mass), bool)
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if held is not None and held[0] != keys[s]:
                    extra.append((*held[1], held[2], False))
                    held = None
                m = np.concatenate([[held[2]], mass[s:e]]) if held else mass[s:e].copy()
                left = pivot(m, np.concatenate([[0.5], u[s:e]]) if held else u[s:e])
                if held:
                    if left == 0:
                        held = (held[0], held[1], m[0])
                    else:
                        extra.append((*held[1], m[0], True))
                        held = None
                    m, left = m[1:], left - 1
                mass[s:e] = m
                if left >= 0:
                    i = s + left
                    held = (keys[s], (b.column("doc_id")[i].as_py(), source[i], b.column("whole")[i].as_py(), part[i]), m[left])
                    open_at[i] = True
            keep = pa.array(~open_at)
            done = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("whole"), pa.array(mass), b.column("part"), pa.array(np.ones(len(mass), bool))], schema=_arrow()).filter(keep)
            yield done
            if extra:
                yield _rows(extra)
        if held is not None:
            yield _rows([(*held[1], held[2], False)])

    return run


def _arrow() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("whole", pa.int64()), ("mass", pa.float64()), ("part", pa.int32()), ("done", pa.bool_())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"doc_id": r[0], "source": r[1], "whole": r[2], "part": r[3], "mass": r[4], "done": r[5]} for r in rows], schema=_arrow())


def copies(docs: DataFrame, size: str = "n_chars", source: str = "source", alpha: float = ALPHA, epochs: float = EPOCHS, targets: DataFrame | None = None, fan_in: int = FAN_IN, seed: int = SEED, parts: int | None = None) -> DataFrame:
    """``doc_id, source, copies`` for each document."""
    spark = docs.sparkSession
    parts = parts or partitions(spark)
    whole_ids = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    number = F.col("doc_id").cast("long") if whole_ids else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    units = docs.select(number.alias("doc_id"), F.col("doc_id").alias("id"), F.col(source).alias("source"), F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("size")).groupBy("doc_id").agg(F.min("id").alias("id"), F.min("source").alias("source"), F.sum("size").alias("size"))
    units = written(units)
    held = units.groupBy("source").agg(F.sum("size").alias("held"))
    share = held.select("source", "held", F.pow("held", F.lit(alpha)).alias("w")) if targets is None else held.join(targets.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("w")), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "held", F.coalesce("w", F.lit(0.0)).alias("w"))
    whole = share.agg(F.sum("held").alias("all_held"), F.sum("w").alias("all_w"))
    rate = share.crossJoin(whole).select(F.col("source").alias("__source"), F.when((F.col("held") > 0) & (F.col("all_w") > 0), F.col("w") / F.col("all_w") * F.col("all_held") * epochs / F.col("held")).otherwise(1.0).alias("rate"))
    level = units.join(rate, F.col("source").eqNullSafe(F.col("__source"))).select("doc_id", "source", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("mass"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    state = level.withColumn("done", F.lit(False)).repartitionById(parts, "part").sortWithinPartitions("part", "source", "doc_id").mapInArrow(_round(seed, True), _STATE)
    state = written(state)
    decided, groups, depth = [state.filter("done")], parts, 0
    while True:
        left = state.filter("not done")
        last = groups == 1
        groups, depth = -(-groups // fan_in), depth + 1
        up = left.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).repartitionById(groups, "part").sortWithinPartitions("part", "source", "doc_id")
        state = written(up.mapInArrow(_round(seed + depth, not last), _STATE))  # a row a source and group
        decided.append(state.filter("done"))
        if last:
            break

    @F.pandas_udf("double")
    def chance(ids):
        import pandas as pd

        return pd.Series(uniform(ids.fillna(-1).to_numpy(), seed - 1))

    root = state.filter("not done").withColumn("mass", (chance("doc_id") < F.col("mass")).cast("double"))
    out = root
    for d in decided:
        out = out.unionByName(d)
    out = out.select("doc_id", "source", (F.col("whole") + F.round("mass").cast("long")).alias("copies"))
    if whole_ids:
        return out.withColumn("doc_id", F.col("doc_id").cast(id_type(docs)))
    names = units.select(F.col("doc_id").alias("n"), "id")
    return out.join(names, F.col("doc_id").eqNullSafe(F.col("n"))).select(F.col("id").alias("doc_id"), "source", "copies")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents with all their columns, each as often as :func:`copies` says, numbered by ``copy_no`` from 0 (a column of that name is set anew)."""
    key, times = free_name(docs, "__id"), free_name(docs, "__n")
    n = copies(docs, **options).select(F.col("doc_id").alias(key), F.col("copies").alias(times)).filter(F.col(times) > 0)
    with_id = docs.filter(F.col("doc_id").isNotNull()).join(n, F.col("doc_id") == F.col(key))
    # all rows without a doc_id are one document, of whose copies there is one number: no exchange by a key that they share
    none = docs.filter(F.col("doc_id").isNull()).join(F.broadcast(n.filter(F.col(key).isNull())), F.col("doc_id").eqNullSafe(F.col(key)))
    names = [F.col(c) for c in docs.columns if c.lower() != "copy_no"]
    return with_id.unionByName(none).select(*names, F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)).alias("copy_no"))
