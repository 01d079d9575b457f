"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of ``passage`` words; consecutive ones overlap
by half.  A passage is a TF-IDF vector over all words, hashed to ``2**bits``
terms; the document frequencies are counted over the passages of all documents.
A randomised SVD of the whole passage matrix A (Nystroem form of Halko,
Martinsson and Tropp 2011) takes one pass: each task multiplies its rows,
A'(A G) with a random G of ``rank`` + ``over`` columns, the products are summed,
and the driver factors the small result into the right singular vectors V.
There is one space for all items, however many.

Candidates are found in two ways.  First, all pairs of a passage and an item in
which a share of ``lcs`` of the item's words stand near the passage, in any
order: a bound of the subsequence below, so of the pairs that comparing
everything with everything would find none is lost.  (A cosine alone loses
them: a short item fills a part of its passage only, and the other words pull
the cosine down however exact the copy is.)  Second, paraphrases: pairs whose
cosine in the latent space is at least ``cosine``, of which a share of ``loose``
of the words, and of ``told`` of the answer, is asked only.

A candidate is verified on words: the longest common subsequence of the item
and the passage with ``len(item)`` words on both sides must have ``lcs`` of the
item's words, and of its answer (its last sentence, or its last third if it has
but one) a share of ``answer``; or ``sure`` of the item's words; or be a
paraphrase as above.

Items of more than ``chunk`` are looked for in parts, a pass each, so what is
sent to the tasks has a bound; the result is the same for any ``chunk``.

Defined results: null and empty texts and items match nothing; an item of
fewer than ``RUN`` words must stand as it is, its words in a row, since a
subsequence of so few says nothing; of several passages of a document that
match an item the best is reported (ties: the first); repeated rows are each
answered; ids may be of any type; other columns are ignored, or passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._spark import id_type
from ._text import M1, Words, find_words, mix, slices

BITS, RANK, OVER, PASSAGE, COSINE, LCS, ANSWER, SURE, LOOSE, TOLD, CHUNK, SEED = 15, 64, 16, 64, 0.85, 0.65, 0.5, 0.85, 0.55, 0.8, 2000, 5
#: items of fewer words must stand as they are; words of the items of a chunk, in characters; words worked off at once
RUN, CHUNK_CHARS, BLOCK = 5, 4 << 20, 1 << 14


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` words in a row."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * M1) + h[k : len(h) - n + 1 + k]
    return mix(out)


class Items:
    """Benchmark items as word hashes, with their terms; those of fewer than ``RUN`` words apart, in ``runs``."""

    def __init__(self, rows: list[tuple], bits: int = 16):
        self.ids, self.words, self.answer_from, self.keys = [], [], [], []
        self.runs: dict[int, dict[int, list]] = {}
        for key, text in rows:
            w = find_words(pa.array([text]), lower=True)
            h = w.hashes()
            if len(h) < RUN:
                if len(h):
                    self.runs.setdefault(len(h), {}).setdefault(int(run_hash(h, len(h))[0]), []).append((key, h))
                continue
            body = (text or "").rstrip()
            ends = [m.end() for m in re.finditer(r"[.!?:]\s+", body)]
            before = len(find_words(pa.array([body[: ends[-1]]]), lower=True).start) if ends else 0
            self.ids.append(key)
            self.words.append(h)
            self.answer_from.append(before if 0 < before < len(h) else len(h) - max(1, len(h) // 3))
        self.vocab = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.terms = np.unique(self.vocab >> np.uint64(64 - bits), return_inverse=True)
        self.term_of = self.terms[1].astype(np.int64)
        self.n_terms = len(self.terms[0])
        self.sizes = np.array([len(x) for x in self.words], np.int64)
        self.longest = int(self.sizes.max()) if self.words else 0
        term = self.term_of[np.searchsorted(self.vocab, np.concatenate(self.words))] if self.words else np.zeros(0, np.int64)
        pairs, self.times = np.unique(term * len(self.ids) + np.repeat(np.arange(len(self.ids)), self.sizes), return_counts=True)
        self.holders = pairs % max(1, len(self.ids))  # items of each term, and how often they have it
        self.from_term = np.searchsorted(pairs // max(1, len(self.ids)), np.arange(self.n_terms + 1))
        self.masks = []
        for h in self.words:
            m: dict[int, int] = {}
            for i, x in enumerate(h.tolist()):
                m[x] = m.get(x, 0) | 1 << i
            self.masks.append(m)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of words that items have, and their terms."""
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        hit = np.flatnonzero(self.vocab[at] == h)
        return hit, self.term_of[at[hit]]

    def overlap(self, half: np.ndarray, term: np.ndarray, n_halves: int, least: float, enough: float):
        """What bounds the words that an item shares with a range of halves.

        The terms most frequent here are looked up as present or not, the others
        are summed by half.  The result gives, of passages base..top - 1, the
        (passage, item) whose bound reaches a share of ``least``, and whether it reaches ``enough``.
        """
        often = np.bincount(term, minlength=self.n_terms)
        place = np.full(self.n_terms, -1)
        top_terms = np.argsort(-often, kind="stable")[:COMMON]
        place[top_terms] = np.arange(len(top_terms))
        width = len(self.ids)
        times = np.zeros((len(top_terms), width), np.float32)
        of = np.repeat(place, np.diff(self.from_term))
        times[of[of >= 0], self.holders[of >= 0]] = self.times[of >= 0]
        present = np.zeros((n_halves + 1, len(top_terms)), np.int32)
        is_common = place[term] >= 0
        present[half[is_common] + 1, place[term[is_common]]] = 1
        present = np.cumsum(present, axis=0, dtype=np.int32)
        half, term = half[~is_common], term[~is_common]
        size = self.from_term[term + 1] - self.from_term[term]
        at = np.repeat(self.from_term[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(term) else np.zeros(0, np.int64)
        half, item, rare_times = np.repeat(half, size), self.holders[at], self.times[at]
        need, plenty = (np.ceil(x * self.sizes - 1e-9).astype(np.float32) for x in (least, enough))

        def near(base: int, top: int, low: int, high: int, step: int, lo_doc: np.ndarray, hi_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            s, e = np.searchsorted(half, low), np.searchsorted(half, high)
            sums = np.bincount((half[s:e] - low + 1) * width + item[s:e], rare_times[s:e], minlength=(high - low + 1) * width)
            sums = np.cumsum(sums.reshape(-1, width), axis=0).astype(np.float32)
            reach = -(-self.sizes // step) * (1 << 20) + -(-2 * self.sizes // step)
            p = np.arange(base, top)
            rows, cols, strong = [], [], []
            for c in np.unique(reach):  # items of like length have the same range
                mine = np.flatnonzero(reach == c)
                from_, to = np.maximum(lo_doc[base:top], p - (c >> 20)), np.minimum(hi_doc[base:top], p + 2 + (c & (1 << 20) - 1))
                part = sums[:, mine]
                bound = part[to - low] - part[from_ - low]
                bound += (present[to] > present[from_]).astype(np.float32) @ times[:, mine]
                r, k = np.nonzero(bound >= need[mine])
                rows.append(r)
                cols.append(mine[k])
                strong.append(bound[r, k] >= plenty[mine[k]])
            rows, cols, strong = np.concatenate(rows), np.concatenate(cols), np.concatenate(strong)
            order = np.lexsort((cols, rows))
            return rows[order] + base, cols[order], strong[order]

        return near

    def matched(self, i: int, region: list[int]) -> int:
        """Bits of the words of item ``i`` that a longest common subsequence with ``region`` uses up (Hyyroe's bit vectors)."""
        mask = self.masks[i]
        full = (1 << len(self.words[i])) - 1
        v = full
        for x in region:
            m = mask.get(x)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return ~v & full


def half_passages(off: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of passages: first half of each document, and the document of each half."""
    half = passage // 2
    n = -(-np.diff(off) // half)
    return np.concatenate([[0], np.cumsum(n)]), np.repeat(np.arange(len(off) - 1), n)


def sparse(items: Items, w: Words, passage: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(half, term, count) of the words that items have, sorted; the first half of each document; the document of each half."""
    first, owner = half_passages(w.off, passage)
    hit, term = items.find(w.hashes() if h is None else h)
    doc = w.doc_of()[hit]
    half = first[doc] + (hit - w.off[doc]) // (passage // 2)
    pairs, count = np.unique(half * items.n_terms + term, return_counts=True)
    return pairs // items.n_terms, pairs % items.n_terms, count, first, owner


COMMON, CHUNK_ROWS, LONG = 64, 2048, 24


def terms_of(h: np.ndarray, bits: int) -> np.ndarray:
    """The term of each word."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def halves_of(w: Words, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First half of each document, the document of each half, and where the words of each half begin (and end)."""
    first, owner = half_passages(w.off, passage)
    return first, owner, np.append(w.off[owner] + (np.arange(len(owner)) - first[owner]) * (passage // 2), len(w.start))


def distinct(term: np.ndarray, place: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Different ``term * n + place``, sorted; ``place`` is sorted, so a stable sort by terms alone (by radix, up to 16 bits) does."""
    order = np.argsort(term.astype(np.uint16) if bits <= 16 else term, kind="stable")
    keys = term[order] * n + place[order]
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


def passage_frequencies(w: Words, passage: int, bits: int) -> tuple[np.ndarray, int]:
    """In how many passages of these texts each term stands, and how many passages there are."""
    first, owner, start = halves_of(w, passage)
    if not len(owner):
        return np.zeros(2**bits, np.int64), 0
    n = len(owner) + w.n_docs + 1
    half = np.repeat(np.arange(len(owner)), np.diff(start))
    keys = distinct(terms_of(w.hashes(), bits), half + owner[half], n, bits)  # with a gap between documents
    term, half = keys // n, keys % n
    # a term of a half is in the passage that begins with it, and in the one before; the last half begins none unless it is alone
    place = np.arange(len(owner)) + owner
    begins, ends = np.zeros(n, bool), np.zeros(n, bool)
    alone = np.diff(first)[owner] == 1
    ends[place] = np.arange(len(owner)) > first[owner]
    begins[place] = (np.arange(len(owner)) + 1 < first[owner + 1]) | alone
    both = np.zeros(len(keys), bool)
    both[1:] = np.diff(keys) == 1  # also in the half before: one passage holds both
    return np.bincount(term, begins[half].astype(np.int64) + ends[half] - both, minlength=2**bits).astype(np.int64), int(begins.sum())


def _frequencies(passage: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(2**bits + 1, np.int64)
        for b in slices(batches, "text"):
            mine, n = passage_frequencies(find_words(b.column("text"), lower=True), passage, bits)
            df[:-1] += mine
            df[-1] += n
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used])], ["term", "df"])

    return run


def gaussian(n: int, k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, k)).astype(np.float32)


def half_sums(term: np.ndarray, start: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``m`` of each half's terms; no half is empty."""
    out = np.empty((len(start) - 1, m.shape[1]), np.float32)
    at = 0
    while at < len(out):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + BLOCK, side="right")) - 1)
        size = np.diff(start[at : stop + 1])
        whole = np.flatnonzero(size == size.max())  # all but the last of each text, as a rule: these are products with ones
        words = start[at + whole][:, None] + np.arange(size.max())
        out[at + whole] = np.matmul(np.ones((1, size.max()), np.float32), m[term[words]])[:, 0]
        rest = np.flatnonzero(size < size.max())
        if len(rest):
            n = size[rest]
            begin = np.cumsum(n) - n
            words = np.repeat(start[at + rest] - begin, n) + np.arange(n.sum())
            out[at + rest] = np.add.reduceat(m[term[words]], begin, axis=0)
        at = stop
    return out


def run_sums(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """As ``np.add.reduceat(x, cut, axis=0)``: the first rows of all runs, then the second ones, and so on; the few long runs one by one."""
    size = np.diff(np.append(cut, len(x)))
    out, k, more = x[cut], 1, np.flatnonzero(size > 1)
    while len(more) >= LONG:
        out[more] += x[cut[more] + k]
        k += 1
        more = more[size[more] > k]
    for i in more.tolist():
        out[i] += x[cut[i] + k : cut[i] + size[i]].sum(axis=0)
    return out


def product(w: Words, passage: int, weighted: np.ndarray, total: np.ndarray) -> None:
    """Adds H'S'(S H ``weighted``) to ``total``, with H the halves' term counts and S the sum of a half and the next, so that S H has a row a passage."""
    bits = len(weighted).bit_length() - 1
    first, owner, start = halves_of(w, passage)
    if not len(owner):
        return
    term = terms_of(w.hashes(), bits)
    x = half_sums(term, start, weighted)
    follows = np.flatnonzero(owner[1:] == owner[:-1])
    y = np.zeros_like(x)  # a passage, at its first half
    y[follows] = x[follows] + x[follows + 1]
    alone = np.diff(first)[owner] == 1
    y[alone] = x[alone]
    z = y.copy()
    z[follows + 1] += y[follows]
    at = 0
    while at < len(owner):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + BLOCK, side="right")) - 1)
        mine = term[start[at] : start[stop]]
        order = np.argsort(mine.astype(np.uint16) if bits <= 16 else mine, kind="stable")
        half = np.repeat(np.arange(at, stop), np.diff(start[at : stop + 1]))[order]
        mine = mine[order]
        cut = np.flatnonzero(np.diff(mine, prepend=-1))
        total[mine[cut]] += run_sums(z[half], cut)
        at = stop


def _sketch(idf: np.ndarray, k: int, seed: int, passage: int):
    """Each task's share of A'(A G), a row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = gaussian(len(idf), k, seed) * idf[:, None].astype(np.float32)
        total = np.zeros((len(idf), k))
        for b in slices(batches, "text"):
            product(find_words(b.column("text"), lower=True), passage, weighted, total)
        used = np.flatnonzero(total.any(axis=1))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * k), pa.array((total[used] * idf[used, None]).astype(np.float32).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), rows], ["term", "y"])

    return run


def _summed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            y = b.column("y").flatten().to_numpy().reshape(-1, k)
            for t, row in zip(b.column("term").to_pylist(), y, strict=True):
                if t in sums:
                    sums[t] += row
                else:
                    sums[t] = row.astype(np.float64)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[t].astype(np.float32).tolist() for t in keys], pa.list_(pa.float32()))], ["term", "y"])

    return run


def singular_vectors(y: np.ndarray, g: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of A from Y = A'A G (Nystroem)."""
    scale = np.sqrt(len(y)) * np.finfo(np.float32).eps * np.linalg.norm(y)  # the products are summed from single precision
    if scale == 0:
        return np.zeros((len(y), 1), np.float32)
    shifted = y + scale * g
    core = g.T @ shifted
    core = (core + core.T) / 2
    vals, vecs = np.linalg.eigh(core)
    keep = vals > vals.max() * 1e-6
    b = shifted @ (vecs[:, keep] / np.sqrt(vals[keep]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    return u[:, : min(rank, int((s > s[0] * 1e-6).sum()))].astype(np.float32)


def train(docs: DataFrame, bits: int = BITS, rank: int = RANK, over: int = OVER, passage: int = PASSAGE, seed: int = SEED) -> np.ndarray:
    """The latent space of all passages of ``docs``: what a term adds to a passage's place in it (2**bits rows)."""
    text = docs.select("text")
    df = np.zeros(2**bits + 1)
    for r in text.mapInArrow(_frequencies(passage, bits), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most 2**bits
        df[r["term"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-3
    k = rank + over
    y = np.zeros((2**bits, k))
    parts = text.mapInArrow(_sketch(idf, k, seed, passage), "term int, y array<float>").repartition("term").mapInArrow(_summed(k), "term int, y array<float>")
    for batch in parts.toArrow().to_batches():
        if batch.num_rows:
            y[batch.column("term").to_numpy()] += batch.column("y").flatten().to_numpy().reshape(-1, k)
    v = singular_vectors(y, gaussian(2**bits, k, seed).astype(float), rank)
    return (idf[:, None] * v).astype(np.float32)


class Model:
    """What the tasks of the search need: items and the latent space."""

    def __init__(self, items: Items, space: np.ndarray):
        self.items, self.space = items, space
        self.bits = len(space).bit_length() - 1
        self.q = np.array([self.place(h) for h in items.words]).reshape(len(items.words), space.shape[1])

    def place(self, h: np.ndarray) -> np.ndarray:
        x = self.space[terms_of(h, self.bits)].sum(axis=0)
        return x / max(float(np.linalg.norm(x)), 1e-12)

    def places(self, at: np.ndarray, h: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Places of the passages whose first halves are ``at``, of length 1."""
        last = np.minimum(at + 1, len(owner) - 1)
        end = np.where(owner[last] == owner[at], start[last + 1], start[at + 1])
        out = np.empty((len(at), self.space.shape[1]), np.float32)
        for i in range(0, len(at), 256):
            a, n = start[at[i : i + 256]], (end - start[at])[i : i + 256]
            words = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[i : i + 256] = np.add.reduceat(self.space[terms_of(h[words], self.bits)], np.cumsum(n) - n, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def search(model: Model, texts: pa.Array, passage: int = PASSAGE, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, sure: float = SURE, loose: float = LOOSE, told: float = TOLD) -> list[tuple]:
    """(text, item_id, first word, end word, cosine, share of the item in order) of each text and item that match."""
    items = model.items
    w = find_words(texts, lower=True)
    h = w.hashes()
    first, owner, start = halves_of(w, passage)
    if not len(owner):
        return []
    step = passage // 2
    best: dict[tuple, tuple] = {}  # by text and number of the item: share, place, first and end word, cosine

    def close(at: np.ndarray, q: np.ndarray) -> np.ndarray:
        used, which = np.unique(at, return_inverse=True)
        return (model.places(used, h, owner, start)[which] * model.q[q]).sum(axis=1)

    if items.ids:
        half, term, _, _, _ = sparse(items, w, passage, h)
        strict = min(lcs, sure)
        reach = -(-2 * items.longest // step) + 2
        near = items.overlap(half, term, len(owner), min(strict, loose), strict)
        lo_doc, hi_doc = first[owner], first[owner + 1]
        rows = max(64, min(CHUNK_ROWS, (4 << 20) // len(items.ids)))
        for i in range(0, len(owner) if len(half) else 0, rows):
            top = min(len(owner), i + rows)
            p, q, strong = near(i, top, max(0, i - reach), min(len(owner), top + reach), step, lo_doc, hi_doc)
            cos = np.full(len(p), np.nan)
            weak = np.flatnonzero(~strong)
            cos[weak] = close(p[weak], q[weak])
            keep = np.flatnonzero(strong | (cos >= cosine))
            for pp, qq, c in zip(p[keep].tolist(), q[keep].tolist(), cos[keep].tolist(), strict=True):
                d = int(owner[pp])
                size = len(items.words[qq])
                a = max(int(w.off[d]), int(w.off[d]) + (pp - int(first[d])) * step - size)
                b = min(int(w.off[d + 1]), a + passage + 2 * size)
                used = items.matched(qq, h[a:b].tolist())
                share = used.bit_count() / size
                of_answer = (used >> items.answer_from[qq]).bit_count() / (size - items.answer_from[qq])
                found = share >= sure or share >= lcs and of_answer >= answer
                if not found and share >= loose and of_answer >= told:
                    c = c if c == c else float(close(np.array([pp]), np.array([qq]))[0])
                    found = c >= cosine
                if found and ((d, qq) not in best or share > best[d, qq][0]):
                    best[d, qq] = (share, pp, a - int(w.off[d]), b - int(w.off[d]))
    out = []
    if best:
        keys = sorted(best)
        cos = close(np.array([best[k][1] for k in keys]), np.array([k[1] for k in keys]))
        out = [(k[0], items.ids[k[1]], best[k][2], best[k][3], float(c), best[k][0]) for k, c in zip(keys, cos, strict=True)]
    for n, runs in items.runs.items():
        r = run_hash(h, n)
        names = np.sort(np.array(list(runs), np.uint64))
        at = np.flatnonzero(names[np.minimum(np.searchsorted(names, r), len(names) - 1)] == r)
        doc = np.searchsorted(w.off, at, side="right") - 1
        inside = at + n <= w.off[doc + 1]
        seen = set()
        for i, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
            if (d, r[i]) not in seen:  # the first place in each text
                seen.add((d, r[i]))
                here = int(first[d]) + min((i - int(w.off[d])) // step, int(first[d + 1] - first[d]) - 1)
                place = model.places(np.array([here]), h, owner, start)[0]
                out += [(d, key, i - int(w.off[d]), i - int(w.off[d]) + n, float(place @ model.place(x)), 1.0) for key, x in runs[int(r[i])]]
    return out


def _models(docs: DataFrame, benchmark: DataFrame, chunk: int, passage: int, **options) -> list[Model]:
    """A model for each part of the items; the space is the same."""
    rows = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(-(-n // chunk), -(-chars // CHUNK_CHARS))
    space, got = None, []
    for k in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        items = Items([(r[0], r[1]) for r in part])
        if items.ids or items.runs:
            space = train(docs, passage=passage, **options) if space is None else space
            got.append(Model(items, space))
    return got


def contaminated(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, sure: float = SURE, chunk: int = CHUNK, **options) -> DataFrame:
    """``doc_id, item_id, start_word, end_word, cosine, lcs`` of each document and item that it holds."""
    item = benchmark.schema["item_id"].dataType
    schema = f"doc_id {id_type(docs)}, item_id {item.simpleString()}, start_word int, end_word int, cosine double, lcs double"
    item_type = to_arrow_type(item)
    out = docs.sparkSession.createDataFrame([], schema)
    for model in _models(docs, benchmark, chunk, passage, **options):
        shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits * rank numbers, and a chunk of items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                got = search(shared.value, b.column("text"), passage, cosine, lcs, answer, sure)
                cols = [b.column("doc_id").take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], item_type)]
                cols += [pa.array([g[k] for g in got], t) for k, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.float64()), (5, pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "start_word", "end_word", "cosine", "lcs"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER, sure: float = SURE, chunk: int = CHUNK, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    for model in _models(docs, benchmark, chunk, passage, **options):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in search(shared.value, b.column("text"), passage, cosine, lcs, answer, sure)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
