"""Lexical gravity and directional counts, from the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import log2_safe, log_safe
from .contingency import Contingency
from .kernel import Tokens, batches_of, counted, groups_of, looked_up, spans, starts_of
from .pairs import blocks, kinds

FORMULAS = ("original", "simplified", "pmi_weighted")


class Links:
    """Rows ``by``, Node, Collocate, n_right, n_left (tokens in all windows of a side), n_left_pos (positions in any left window); Collocate null: occurrences of the node, in n_right."""

    def __init__(self, nodes: list[str], window: int, by: list[str]):
        self.nodes, self.window, self.by = [n.split() for n in nodes], window, by

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "__text"):
            t = Tokens(b.column("__text"))
            group, firsts = groups_of(b, self.by)
            code = t.code_of(w for node in self.nodes for w in node)
            for node in self.nodes:
                if not all(w in code for w in node):
                    continue
                coded = tuple(code[w] for w in node)
                start = starts_of(t, coded, np.flatnonzero(t.codes == coded[0]))
                if len(start):
                    yield self.links(b, t, start, node, group, firsts)

    def links(self, b: pa.RecordBatch, t: Tokens, start: np.ndarray, node: list[str], group: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
        doc = t.doc_of(start)
        end = start + len(node)
        right, r = spans(end, np.minimum(t.off[doc + 1], end + self.window))
        left, o = spans(np.maximum(t.off[doc], start - self.window), start)
        v = t.n_words
        g = group[doc]
        r_key, r_n = counted(g[r] * v + t.codes[right])
        l_key, l_n = counted(g[o] * v + t.codes[left])
        once = np.unique(left)
        p_key, p_n = counted(group[t.doc_of(once)] * v + t.codes[once])
        keys = np.union1d(r_key, l_key)
        f_key, f_n = counted(g)
        owner = np.concatenate([keys // v, f_key])
        words = pa.concat_arrays([t.words.take(pa.array(keys % v)).cast(pa.string()), pa.nulls(len(f_key), pa.string())])
        n = [np.concatenate([looked_up(r_key, r_n, keys), f_n]), *[np.concatenate([looked_up(k, x, keys), np.zeros(len(f_key), np.int64)]) for k, x in ((l_key, l_n), (p_key, p_n))]]
        cols = [b.column(x).take(pa.array(firsts[owner])) for x in self.by]
        return pa.RecordBatch.from_arrays([*cols, pa.array([" ".join(node)] * len(owner), pa.string()), words, *map(pa.array, n)], [*self.by, "Node", "Collocate", "n_right", "n_left", "n_left_pos"])


class Before:
    """Rows ``by``, Collocate, prev, n: each pair of a word and one within ``window`` before it once a batch; prev null: how often the word occurs."""

    def __init__(self, window: int, by: list[str]):
        self.window, self.by = window, by

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "__text"):
            t = Tokens(b.column("__text"))
            if not len(t.codes):
                continue
            group, firsts = groups_of(b, self.by)
            v = t.n_words
            doc = t.doc_of(np.arange(len(t.codes)))
            g = group[doc]
            keys = [np.zeros(0, np.int64)]
            for shift in range(1, self.window + 1):
                same = np.flatnonzero(doc[shift:] == doc[:-shift])
                keys.append(np.unique((g[same] * v + t.codes[same + shift]) * v + t.codes[same]))
            pairs = np.unique(np.concatenate(keys))
            f_key, f_n = counted(g * v + t.codes)
            word = np.concatenate([pairs // v, f_key])
            cols = [b.column(x).take(pa.array(firsts[word // v])) for x in self.by]
            prev = pa.concat_arrays([t.words.take(pa.array(pairs % v)).cast(pa.string()), pa.nulls(len(f_key), pa.string())])
            n = np.concatenate([np.zeros(len(pairs), np.int64), f_n])
            yield pa.RecordBatch.from_arrays([*cols, t.words.take(pa.array(word % v)).cast(pa.string()), prev, pa.array(n)], [*self.by, "Collocate", "prev", "n"])


class Occurs:
    """Rows ``by``, Collocate, n: how often each word occurs in a batch."""

    def __init__(self, by: list[str]):
        self.by = by

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "__text"):
            t = Tokens(b.column("__text"))
            group, firsts = groups_of(b, self.by)
            v = max(t.n_words, 1)
            key, n = counted(np.repeat(group, np.diff(t.off)) * v + t.codes)
            cols = [b.column(x).take(pa.array(firsts[key // v])) for x in self.by]
            yield pa.RecordBatch.from_arrays([*cols, t.words.take(pa.array(key % v)).cast(pa.string()), pa.array(n)], [*self.by, "Collocate", "n"])


def _types(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{x}` {df.schema[x].dataType.simpleString()}, " for x in by)


def _links(table: Contingency) -> DataFrame:
    if table.prepared is None:
        raise ValueError("this measure needs the tokens of the corpus")
    held = table.prepared if table.pruned is None else table.pruned
    rows = held.select(*table.by, "__text").mapInArrow(Links(table.nodes, table.windowsize, table.by), f"{_types(table.prepared, table.by)}Node string, Collocate string, n_right long, n_left long, n_left_pos long")
    total = rows.groupBy(*table.keys).agg(*[F.sum(x).alias(x) for x in ("n_right", "n_left", "n_left_pos")])
    node = Window.partitionBy(*table.by, "Node")
    of_node = F.max(F.when(F.col("Collocate").isNull(), F.col("n_right"))).over(node)
    types = F.sum((F.col("Collocate").isNotNull() & (F.col("n_right") > 0)).cast("long")).over(node)
    return total.withColumns({"f_node": of_node, "types_right": types}).filter("Collocate is not null")


def _before(table: Contingency) -> DataFrame:
    """``by``, Collocate, f_coll, types_before (different words before it)."""
    if not table.by:
        found = blocks(table.prepared, table.windowsize, True).mapInArrow(kinds, "x string, n long, f long")
        return found.groupBy(F.col("x").alias("Collocate")).agg(F.sum("f").alias("f_coll"), F.sum("n").alias("types_before"))
    rows = table.prepared.select(*table.by, "__text").mapInArrow(Before(table.windowsize, table.by), f"{_types(table.prepared, table.by)}Collocate string, prev string, n long")
    wanted = table.df.select(*table.by, "Collocate").distinct()
    return rows.join(wanted, [*table.by, "Collocate"], "left_semi").groupBy(*table.by, "Collocate").agg(F.sum("n").alias("f_coll"), F.count_distinct("prev").alias("types_before"))


def _occurrences(table: Contingency) -> DataFrame:
    """``by``, Collocate, f_coll."""
    rows = table.prepared.select(*table.by, "__text").mapInArrow(Occurs(table.by), f"{_types(table.prepared, table.by)}Collocate string, n long")
    return rows.groupBy(*table.by, "Collocate").agg(F.sum("n").alias("f_coll"))


def lexical_gravity(table: Contingency, formula: str = "original") -> DataFrame:
    """``by``, Node, Collocate, LexicalGravity; windows end with the document.

    ``original`` is -Infinity where a word stands on one side of the node only.
    """
    if formula not in FORMULAS:
        raise ValueError(f"formula must be one of {FORMULAS}: {formula!r}")
    keys = table.keys
    rows = table.df.select(*keys, "a").join(_links(table), keys, "left")
    occurs = _before(table) if formula == "original" else _occurrences(table)
    rows = rows.join(occurs, [*table.by, "Collocate"], "left")
    x = {c: F.col(c).cast("double") for c in ("a", "n_right", "n_left_pos", "f_node", "types_right", "f_coll", "types_before") if c in rows.columns}
    if formula == "original":
        some = (F.col("n_right") > 0) & (F.col("n_left_pos") > 0) & (F.col("types_right") > 0) & (F.col("types_before") > 0)
        score = F.when(some, F.log(x["n_right"] * x["types_right"] / x["f_node"]) + F.log(x["n_left_pos"] * x["types_before"] / x["f_coll"])).otherwise(F.lit(float("-inf")))
    elif formula == "simplified":
        score = 2.0 * log2_safe(x["a"]) + log2_safe(F.lit(2.0 * table.windowsize)) - log2_safe(x["f_node"]) - log2_safe(x["f_coll"])
    else:
        total = occurs.groupBy(*table.by).agg(F.sum("f_coll").cast("double").alias("__total"))
        rows = rows.join(total, table.by) if table.by else rows.crossJoin(total)
        score = x["a"] * log_safe(x["a"] * F.col("__total") / (x["f_node"] * x["f_coll"]))
    return rows.select(*keys, score.alias("LexicalGravity"))


def directional(table: Contingency) -> DataFrame:
    """``by``, Node, Collocate, Left, Right (shares of the tokens in the windows) and Asymmetry, (right - left) / both."""
    rows = table.df.select(*table.keys).join(_links(table), table.keys, "left")
    left, right = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("n_left", "n_right"))
    total = left + right
    share = {"Left": left, "Right": right, "Asymmetry": right - left}
    return rows.select(*table.keys, *[F.when(total > 0, x / total).otherwise(0.0).alias(k) for k, x in share.items()])


def gravity_analysis(table: Contingency) -> DataFrame:
    """All three formulas (Original, Simplified, PMIWeighted) beside the directional shares."""
    out = directional(table)
    for name, formula in (("Original", "original"), ("Simplified", "simplified"), ("PMIWeighted", "pmi_weighted")):
        out = out.join(lexical_gravity(table, formula).withColumnRenamed("LexicalGravity", name), table.keys, "left")
    return out
