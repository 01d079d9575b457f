"""Counting of words around nodes, for a batch of tokenised documents at a time.

Window functions over exploded tokens would shuffle every token of the corpus
by document and sort it.  A document's tokens stand in one row already, so its
counts are made where the row is, in numpy, summed for the batch, and only the
sums travel.  The kernel needs no state, so it serves batch and stream alike.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP_BYTES = 1 << 20


def batches_of(batches: Iterable[pa.RecordBatch], text: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``step`` bytes of text, one row at least.

    What a batch needed goes back to the system before the next one, so that a
    worker holds no more than one batch takes, however many it works off.
    """
    keep_little()
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, n = 0, b.num_rows
        while at < n:
            base = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, base + step, side="right")))
            yield b.slice(at, stop - at)
            at = stop
            pa.default_memory_pool().release_unused()
        del b, size  # before the next one is read


def keep_little() -> None:
    """Let glibc map arrays from a megabyte on one by one, so that they are given back once they are free; elsewhere nothing."""
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise grows with what is freed
    except (AttributeError, OSError):
        pass


class Tokens:
    """Tokens of some documents as codes into a dictionary; those of document i are off[i]..off[i + 1] - 1."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.split_pattern(texts, " ")
        flat, off = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        off = off - off[0]
        real = pc.not_equal(flat, "")
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        self.off = before[off]
        coded = flat.filter(real).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary
        self.n_docs, self.n_words = len(texts), len(self.words)

    def code_of(self, words: Iterable[str]) -> dict[str, int]:
        wanted = pa.array(sorted(set(words)), pa.large_string())
        at = pc.index_in(wanted, self.words)
        return {w: c for w, c in zip(wanted.to_pylist(), at.to_pylist(), strict=True) if c is not None}

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, positions, side="right") - 1


def starts_of(t: Tokens, node: tuple[int, ...], where: np.ndarray) -> np.ndarray:
    """Positions, among ``where`` (those of the node's first word), at which the node begins."""
    n = len(node)
    at = where[where + n <= len(t.codes)]
    for i in range(1, n):
        at = at[t.codes[at + i] == node[i]]
    return at[t.off[t.doc_of(at) + 1] >= at + n]


def spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions start[i]..stop[i] - 1, and i for each."""
    n = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(start)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), owner


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def cells(t: Tokens, start: np.ndarray, n: int, window: int, minfreq: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word code, a, b, c, d) of all documents for one node of ``n`` words that begins at ``start``.

    a counts the positions that at least one window covers; b, the occurrences
    of the node whose window lacks the word; c, the word outside of all windows
    and nodes; d, all other words there that no window of the document has, less c.
    """
    v = t.n_words
    docs = np.unique(t.doc_of(start))
    pos, local = spans(t.off[docs], t.off[docs + 1])  # only documents with the node
    size = t.off[docs + 1] - t.off[docs]
    base = t.off[docs] - (np.cumsum(size) - size)
    doc = np.searchsorted(docs, t.doc_of(start))
    lo, hi = t.off[docs][doc] - base[doc], t.off[docs + 1][doc] - base[doc]
    s = start - base[doc]
    code = t.codes[pos]
    left, right = np.maximum(lo, s - window), np.minimum(hi, s + n + window)

    def covered(*ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        edge = np.zeros(len(pos) + 1, np.int64)
        for x, y in ranges:
            edge += np.bincount(x, minlength=len(edge)) - np.bincount(y, minlength=len(edge))
        return np.cumsum(edge[:-1]) > 0

    ctx = covered((left, s), (s + n, right))
    out = ~(ctx | covered((s, s + n)))
    a_key, a = counted((local * v + code)[ctx])
    keep = a >= minfreq
    a_key, a = a_key[keep], a[keep]
    c_key, c_all = counted((local * v + code)[out])
    c = looked_up(c_key, c_all, a_key)
    p1, o1 = spans(left, s)
    p2, o2 = spans(s + n, right)
    seen = np.unique(np.concatenate([o1, o2]) * v + code[np.concatenate([p1, p2])])
    u_key, u = counted(doc[seen // v] * v + seen % v)
    owner = a_key // v
    f = np.bincount(doc, minlength=len(docs))
    rest = np.bincount(local[out], minlength=len(docs)) - np.bincount(owner, c, minlength=len(docs)).astype(np.int64)
    return docs[owner], a_key % v, a, f[owner] - looked_up(u_key, u, a_key), c, rest[owner] - c


class Counter:
    """``mapInArrow`` function: rows (group, text) to ``by``, Node, Collocate, a, b, c, d, DocFrequency, summed for each batch."""

    def __init__(self, nodes: list[str], window: int, minfreq: int, by: list[str], per_doc: bool = False):
        self.nodes, self.window, self.minfreq, self.by, self.per_doc = [n.split() for n in nodes], window, minfreq, by, per_doc

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "__text"):
            yield from self.batch(b)

    def batch(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = Tokens(b.column("__text"))
        if not len(t.codes):
            return
        group, firsts = groups_of(b, self.by)
        code = t.code_of(w for node in self.nodes for w in node)
        present = [(i, tuple(code[w] for w in node)) for i, node in enumerate(self.nodes) if node and all(w in code for w in node)]
        if not present:
            return
        order = np.argsort(t.codes, kind="stable")
        ordered = t.codes[order]
        for i, node in present:
            where = order[np.searchsorted(ordered, node[0]) : np.searchsorted(ordered, node[0], side="right")]
            start = starts_of(t, node, where)
            if not len(start):
                continue
            doc, word, *counts = cells(t, start, len(node), self.window, self.minfreq)
            key = group[doc] * t.n_words + word
            if self.per_doc:
                keys, sums = key, counts
                docs = np.ones(len(key), np.int64)
            else:
                keys, at = np.unique(key, return_inverse=True)
                sums = [np.bincount(at, x, minlength=len(keys)).astype(np.int64) for x in counts]  # counts of a batch are far below 2**53
                docs = np.bincount(at, minlength=len(keys))
            cols = [b.column(x).take(pa.array(firsts[keys // t.n_words])) for x in self.by]
            name = pa.array([" ".join(self.nodes[i])] * len(keys), pa.string())
            cols += [name, t.words.take(pa.array(keys % t.n_words)).cast(pa.string()), *[pa.array(x) for x in [*sums, docs]]]
            yield pa.RecordBatch.from_arrays(cols, [*self.by, "Node", "Collocate", "a", "b", "c", "d", "DocFrequency"])


def groups_of(b: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row by the columns ``by``, and the first row of each group."""
    group = np.zeros(b.num_rows, np.int64)
    for x in by:
        coded = b.column(x).dictionary_encode(null_encoding="encode")
        group = group * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        group = np.unique(group, return_inverse=True)[1]
    _, firsts, group = np.unique(group, return_index=True, return_inverse=True)
    return group, firsts
