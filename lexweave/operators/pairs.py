"""Pairs of words that stand near each other, over all documents.

A row a pair would make most of a corpus' pairs travel as two strings each.
So pairs are counted for some megabytes of text at a time, with numbers in
place of words, and sent in blocks: the words fall into groups, and a block
holds the pairs of two groups with the words it needs.  A task merges one
block.  There are more blocks where ``spark.sql.shuffle.partitions`` is larger.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .kernel import Tokens, batches_of

STEP_BYTES = 8 << 20
ROWS = 1 << 18
BLOCK = "block int, words binary, n long, x binary, y binary, times binary"


def packed(values: np.ndarray, most: int) -> bytes:
    """The values in as few bytes each as ``most`` takes."""
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and the sum of its times."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


class Blocks:
    """``mapInArrow`` function: texts to blocks of pairs x, y within ``window`` of each other.

    ``ordered``: y stands before x, and ``times`` is 1; with an empty y, ``times`` is how often x occurs.  Else x is y or comes before it in order of
    the alphabet, and ``times`` is how often they stand so.  Words of ``stop`` are taken out first.
    """

    def __init__(self, window: int, groups: int, ordered: bool, stop: Iterable[str] = ()):
        self.window, self.groups, self.ordered, self.stop = int(window), groups, ordered, frozenset(stop)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "__text", STEP_BYTES):
            yield from self.of(Tokens(b.column("__text")))

    def of(self, t: Tokens) -> Iterator[pa.RecordBatch]:
        v = t.n_words
        if not v:
            return
        order = pc.sort_indices(t.words)
        words = t.words.take(order).cast(pa.string())
        plain = words.to_pylist()
        rank = np.empty(v, np.int64)
        rank[order.to_numpy()] = np.arange(v)
        code, doc = rank[t.codes], np.repeat(np.arange(t.n_docs, dtype=np.int32), np.diff(t.off))
        if self.stop:
            keep = ~np.fromiter((w.lower() in self.stop for w in plain), bool, v)[code]
            code, doc = code[keep], doc[keep]
        if self.ordered:  # the empty word comes first
            plain, words, code, v = ["", *plain], pa.concat_arrays([pa.array([""], pa.string()), words]), code + 1, v + 1
        keys = [np.zeros(0, np.int64)]
        for s in range(1, self.window + 1):
            same = doc[s:] == doc[:-s]
            before, after = code[:-s][same], code[s:][same]
            keys.append(np.unique(after * v + before) if self.ordered else np.minimum(before, after) * v + np.maximum(before, after))
        key = np.concatenate(keys)
        occur = np.bincount(code, minlength=v)[1:].astype(np.int32) if self.ordered else np.zeros(0, np.int32)
        if not len(key) and not len(occur):
            return
        del keys, code, doc
        key.sort()
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        times = np.ones(len(first), np.int32) if self.ordered else np.diff(np.append(first, len(key))).astype(np.int32)
        key = key[first]
        del first
        if self.ordered:
            key, times = np.concatenate([key, np.arange(1, v) * v]), np.concatenate([times, occur])
        x, y = (key // v).astype(np.int32), (key % v).astype(np.int32)
        del key
        group = np.fromiter((zlib.crc32(w.encode()) % self.groups for w in plain), np.int32, v)
        other = group[np.where(y > 0, y, x)] if self.ordered else group[y]
        low, high = np.minimum(group[x], other), np.maximum(group[x], other)
        block = high * (high + 1) // 2 + low
        del low, high, other
        at = np.argsort(block.astype(np.uint16) if self.groups < 256 else block, kind="stable").astype(np.int32)
        ends = np.cumsum(np.bincount(block))
        rows: list[tuple] = []
        for i, end in enumerate(ends):
            here = at[ends[i - 1] if i else 0 : end]
            if not len(here):
                continue
            used = np.zeros(v, bool)
            used[x[here]] = used[y[here]] = True
            own = np.flatnonzero(used)
            local = np.cumsum(used) - 1
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), words.take(pa.array(own))), " ")[0].as_py()
            rows.append((i, text.encode(), len(here), packed(local[x[here]], len(own)), packed(local[y[here]], len(own)), packed(times[here], int(times[here].max()))))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "words", "n", "x", "y", "times"])


def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, words, x, y, times) of each block of a partition, its parts merged, in order of x and y."""
    parts: list[tuple] = []

    def one() -> tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pa.array([p[1].decode() for p in parts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        code, off = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.offsets)
        v = len(coded.dictionary)
        keys = np.concatenate([code[o + unpacked(x, n)] * v + code[o + unpacked(y, n)] for o, (_, _, n, x, y, _) in zip(off, parts, strict=False)])
        keys, times = summed(keys, np.concatenate([unpacked(p[5], p[2]) for p in parts]))
        return parts[0][0], coded.dictionary, keys // v, keys % v, times

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if parts and parts[0][0] != row[0]:
                yield one()
                parts = []
            parts.append(row)
    if parts:
        yield one()


def both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that aren't ordered to rows x, y, n: twice the times, for both ways, and for a word with itself four times."""
    for _, words, x, y, times in merged(batches):
        words = words.cast(pa.string())
        for i in range(0, len(x), ROWS):
            p, q, n = x[i : i + ROWS], y[i : i + ROWS], 2 * times[i : i + ROWS]
            other = p != q
            a, b = np.concatenate([p, q[other]]), np.concatenate([q, p[other]])
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(np.concatenate([np.where(other, n, 2 * n), n[other]]))], ["x", "y", "n"])


def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered blocks to rows x, n, f: how many different y of the block go with x, and, in one of its blocks, how often x occurs."""
    for _, words, x, y, times in merged(batches):
        v = len(words)
        none = y == pc.index_in(pa.array([""], words.type), words)[0].as_py()
        n, f = np.bincount(x[~none], minlength=v), np.zeros(v, np.int64)
        f[x[none]] = times[none]
        own = np.flatnonzero(n + f)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(own)).cast(pa.string()), pa.array(n[own]), pa.array(f[own])], ["x", "n", "f"])


def blocks(texts: DataFrame, window: int, ordered: bool, stop: Iterable[str] = ()) -> DataFrame:
    """Blocks of the column ``__text`` (tokens joined by blanks), those of one block in one partition."""
    groups = math.ceil(math.sqrt(4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = texts.select("__text").mapInArrow(Blocks(window, groups, ordered, stop), BLOCK)
    return found.repartitionById(groups * (groups + 1) // 2, found["block"])
