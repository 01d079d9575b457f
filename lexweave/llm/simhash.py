"""Near-duplicates by SimHash and Golay-code fuzzy hashing.

A document's fingerprint has 115 bits: each different word votes on every bit
with a weight that grows as the root of its count.  The fingerprint is five
segments of 23 bits.  The binary Golay code [23, 12, 7] is perfect: each
23-bit word lies within 3 bits of exactly one of 4096 codewords.  A segment's keys are the
indices to which the segment, and the segment with any one bit changed,
decode: one key or six.  Two segments that differ in at most 2 bits share a
key, as both reach the word between them.  Of fingerprints that differ in at
most 8 bits at least three segments differ in at most 2 (pigeonhole), and the
pairs of segments in ``PAIRS`` are such that any three segments hold one of them
(Turan), so such fingerprints share a key of a pair for certain, and more
distant ones (up to ``LIMIT`` bits) mostly.

The words' order plays no part in these bits.  So 64 more, voted by the pairs of
neighbouring words, verify: two texts are near if their fingerprints differ in
at most ``LIMIT`` bits and these in at most ``ORDER_LIMIT``.

Fingerprints go to buckets of keys, packed: all those of a batch that fall in
one bucket are one row of byte planes.  The rows of a bucket are counted
before; one with more than ``ROWS`` (a key that many fingerprints have) is split
in g chunks of fingerprints, and a unit of work is a pair of chunks, so that all
partners meet whatever the size.  A unit finds which of its fingerprints hang
together, and passes on one edge a fingerprint, to the least one, not all
pairs: small groups of a key are compared pair by pair, in larger ones the near
ones of a fingerprint leave the list, and fingerprints that hang together
already aren't compared again.

Groups are the connected components of near pairs (alternating large-star and
small-star, in a few rounds of joins); one document of each group stays, that
with the least doc_id.

Defined results: texts that are null, empty or without words, and rows whose
doc_id is null, have no duplicates and stay.  Equal texts have equal
fingerprints and are grouped before any join.  Rows that repeat a doc_id and
its text count as one document; rows that share a doc_id but not the text are
judged one by one, and only those whose text is a duplicate go.  A doc_id may be
of any type that can be ordered.  Other columns are ignored, or passed on by
:func:`drop_near_duplicates`, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import discard, free_name, id_type, partitions, written
from ._text import Words, find_words, mix, slices

SEGMENTS, WIDTH, LIMIT, ORDER_LIMIT = 5, 23, 14, 22
BITS = SEGMENTS * WIDTH
PAIRS = ((0, 1), (0, 2), (1, 2), (3, 4))
GENERATOR = 0xC75
#: rows of a unit of work (28 bytes each) and units, at most; groups of a key up to SMALL are compared pair by pair; fingerprints packed at once
ROWS, BUCKETS, SMALL, PACK = 1 << 18, 1 << 22, 24, 1 << 14
PRINT = ["f1", "f2", "f3"]


@functools.lru_cache(maxsize=1)
def golay() -> np.ndarray:
    """Codeword index of each 23-bit word."""
    msg = np.arange(4096, dtype=np.int64)
    code = np.zeros(4096, np.int64)
    for i in range(12):
        code ^= np.where(msg >> i & 1, GENERATOR << i, 0)
    table = np.full(1 << WIDTH, -1, np.int16)
    for n in range(4):
        for bits in itertools.combinations(range(WIDTH), n):
            table[code ^ sum(1 << b for b in bits)] = msg
    return table


def _votes(w: Words, h: np.ndarray, lanes: int) -> np.ndarray:
    """Bits (n, lanes * 64) on which the different hashes of each text agree, as 64-bit halves."""
    n = w.n_docs
    keys, count = np.unique(w.doc_of().astype(np.uint64) << np.uint64(51) | h >> np.uint64(13), return_counts=True)
    off = np.searchsorted(keys >> np.uint64(51), np.arange(n + 1, dtype=np.uint64))
    first = mix(keys & np.uint64((1 << 51) - 1))
    lane = np.stack([first, mix(first ^ np.uint64(0xA24BAED4963EE407))][:lanes], axis=1)
    weight = np.floor(16 * np.sqrt(count)).astype(np.float32)
    out = np.zeros((n, lanes), np.uint64)
    step = 1 << 15
    for d in np.flatnonzero(np.diff(w.off)):
        votes = np.zeros(64 * lanes)
        for i in range(off[d], off[d + 1], step):
            j = min(i + step, off[d + 1])
            bits = np.unpackbits(lane[i:j].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            votes += weight[i:j] @ bits
        on = votes * 2 > weight[off[d] : off[d + 1]].sum(dtype=np.float64)
        on[BITS:] = False
        out[d] = np.packbits(on, bitorder="little").view(np.uint64)
    return out


def fingerprint_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n, 3) as 64-bit parts, the third of the words' order, and the number of words of each text."""
    w = find_words(texts, lower=True)
    h = w.hashes()
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h
    before[w.off[:-1][np.diff(w.off) > 0]] = 0
    return np.hstack([_votes(w, h, 2), _votes(w, mix(mix(before) + h), 1)]), np.diff(w.off)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, h, f1, f2, f3`` of each row with a doc_id and words; ``h`` is the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 8192):  # 13 bits for the row in _votes
                for b in slices(iter([big.slice(i, 8192)]), "t"):
                    f, words = fingerprint_batch(b.column("t"))
                    keep = np.flatnonzero(words)
                    at = pa.array(keep)
                    f = f[keep].view(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("h").take(at), *(pa.array(f[:, k].copy()) for k in range(3))], ["doc_id", "h", *PRINT])

    rows = docs.select("doc_id", F.col(text).alias("t"), F.xxhash64(text).alias("h")).filter("doc_id is not null")
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, h long, f1 long, f2 long, f3 long")


def segments(f: np.ndarray) -> np.ndarray:
    """The segments (n, 5) of fingerprints."""
    a, b = f[:, 0].view(np.uint64), f[:, 1].view(np.uint64)
    low = np.uint64((1 << WIDTH) - 1)
    s = [a & low, a >> np.uint64(23) & low, (a >> np.uint64(46) | b << np.uint64(18)) & low, b >> np.uint64(5) & low, b >> np.uint64(28) & low]
    return np.stack(s, axis=1).astype(np.int64)


def keys_of(seg: np.ndarray) -> np.ndarray:
    """Keys of each segment of ``seg`` (any shape): six places, in rising order, -1 where there are fewer."""
    around = np.concatenate([[0], 1 << np.arange(WIDTH)])
    k = np.sort(golay()[seg[..., None] ^ around], axis=-1)
    k[..., 1:][k[..., 1:] == k[..., :-1]] = 4096
    k.sort(axis=-1)
    k = k[..., :6]
    return np.where(k == 4096, -1, k).astype(np.int32)


def pair_keys(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all pair keys of fingerprints."""
    k = keys_of(segments(f))
    rows, keys = [], []
    for c, (i, j) in enumerate(PAIRS):
        both = k[:, i, :, None] << 12 | k[:, j, None, :] | c << 24
        r, x, y = np.nonzero((k[:, i, :, None] >= 0) & (k[:, j, None, :] >= 0))
        rows.append(r)
        keys.append(both[r, x, y])
    return np.concatenate(rows), np.concatenate(keys).astype(np.uint32)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def near(a: np.ndarray, b: np.ndarray, limit: int = LIMIT, order_limit: int = ORDER_LIMIT) -> np.ndarray:
    """Whether fingerprints (n, 3) of unsigned parts are near; ``a`` may be one."""
    x = a ^ b
    ok = np.bitwise_count(x[..., 0]) + np.bitwise_count(x[..., 1]) <= limit
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(x[at, 2]) <= order_limit
    return ok


def forest(n: int, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least node with which each hangs together, given the edges (x, y) and what ``label`` says already."""
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
    return label


def hang_together(key: np.ndarray, f: np.ndarray, limit: int = LIMIT, order_limit: int = ORDER_LIMIT, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``f`` that have a near one with the same key, each once, and for each the place of the least one with which it hangs together."""
    order = np.argsort(key, kind="stable")
    key, f = key[order], f[order]
    start = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint32(1)))
    size = np.diff(np.append(start, len(key)))
    group = np.repeat(size, size)
    at, shift = np.flatnonzero((group > 1) & (group <= small)), 1
    left = (np.repeat(start + size, size) - 1 - np.arange(len(key)))[at]  # rows of the group that follow
    found = [np.zeros((2, 0), np.int64)]
    while len(at):
        more = left >= shift
        at, left = at[more], left[more]
        for i in range(0, len(at), 1 << 18):
            x = at[i : i + (1 << 18)]
            x = x[near(f[x], f[x + shift], limit, order_limit)]
            found.append(np.stack([x, x + shift]))
        shift += 1
    pairs = np.concatenate(found, axis=1)
    large = [np.arange(s, s + n) for s, n in zip(start[size > small], size[size > small], strict=True)]
    used = np.unique(np.concatenate([pairs.ravel(), *large]))
    _, first, again = np.unique(f[used].view("V24").ravel(), return_index=True, return_inverse=True)
    node = np.zeros(len(key), np.int64)
    node[used] = again
    prints = f[used[first]]
    label = forest(len(prints), *node[pairs], np.arange(len(prints)))
    for rows in large:
        mine = np.unique(node[rows])
        if (label[mine] != label[mine[0]]).any():
            x, y = _grow(prints[mine], label[mine], limit, order_limit)
            label = forest(len(prints), mine[x], mine[y], label)
    return prints, label


def _grow(f: np.ndarray, label: np.ndarray, limit: int, order_limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of near fingerprints: what is reached leaves the list, with all that has its label."""
    names, lab = np.unique(label, return_inverse=True)
    rest = np.argsort(lab, kind="stable")
    edges, ready = [], []
    while len(rest):
        if ready:
            i = ready.pop()
        else:
            i = int(rest[0])
            same = lab[rest] == lab[i]
            ready += rest[same].tolist()
            rest = rest[~same]
            continue
        hit = rest[near(f[i], f[rest], limit, order_limit)]
        if len(hit):
            reached = np.zeros(len(names), bool)
            reached[lab[hit]] = True
            edges.append((np.full(len(hit), i), hit))
            new = reached[lab[rest]]
            ready += rest[new].tolist()
            rest = rest[~new]
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])


def _parts(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in PRINT], axis=1)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for big in batches:
            for i in range(0, big.num_rows, PACK):
                total += np.bincount(bucket_of(pair_keys(_parts(big.slice(i, PACK)))[1], buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def _emit(buckets: int, chunks: dict[int, int]):
    split = np.ones(buckets, np.int64)
    split[list(chunks)] = list(chunks.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, PACK):
                f = _parts(big.slice(i, PACK))
                row, key = pair_keys(f)
                bucket = bucket_of(key, buckets)
                unit, g = bucket << 30, split[bucket]
                if (g > 1).any():
                    at = np.repeat(np.arange(len(row)), g)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(g) - g, g)
                    row, key, bucket, g = row[at], key[at], bucket[at], g[at]
                    chunk = (mix(f[row, 0].view(np.uint64)) % g.astype(np.uint64)).astype(np.int64)
                    unit = bucket << 30 | np.minimum(chunk, other) << 15 | np.maximum(chunk, other)
                order = np.lexsort((key, unit))
                row, key, unit = row[order], key[order], unit[order]
                cut = np.unique(np.concatenate([np.flatnonzero(np.diff(unit, prepend=-1)), np.arange(0, len(unit), 2048)]))
                # planes: a row's keys, lowest bytes first, then each part of its fingerprints
                n = np.diff(np.append(cut, len(unit)))
                base, step = np.repeat(cut * 28, n), np.arange(len(unit)) - np.repeat(cut, n)
                wide = np.repeat(n, n)
                data = np.empty(len(row) * 28, np.uint8)
                raw = key.view(np.uint8).reshape(-1, 4)
                for k in range(4):
                    data[base + k * wide + step] = raw[:, k]
                raw, at = f[row].view(np.uint8).reshape(-1, 24), base + 4 * wide + 24 * step
                data[at[:, None] + np.arange(24)] = raw
                packed = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer((np.append(cut, len(unit)) * 28).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(unit[cut]), packed], ["unit", "packed"])

    return run


def _compare(limit: int, order_limit: int):
    def edges(raw: list[bytes]) -> pa.RecordBatch:
        size = [len(p) // 28 for p in raw]
        key = np.concatenate([np.ascontiguousarray(np.frombuffer(p, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32).ravel() for p, n in zip(raw, size, strict=True)])
        f = np.concatenate([np.frombuffer(p, np.uint64, 3 * n, 4 * n).reshape(n, 3) for p, n in zip(raw, size, strict=True)])
        prints, label = hang_together(key, f, limit, order_limit)
        far = np.flatnonzero(label != np.arange(len(label)))
        a, b = prints[label[far]].view(np.int64), prints[far].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[:, k].copy()) for x in (a, b) for k in range(3)], ["a1", "a2", "a3", "b1", "b2", "b3"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, raw = None, []
        for b in batches:
            for u, p in zip(b.column("unit").to_pylist(), b.column("packed").to_pylist(), strict=True):
                if u != unit and raw:
                    yield edges(raw)
                    raw = []
                unit = u
                raw.append(p)
        if raw:
            yield edges(raw)

    return run


def near_edges(reps: DataFrame, limit: int = LIMIT, order_limit: int = ORDER_LIMIT, rows: int = ROWS) -> DataFrame:
    """``a, b``: edges between the nodes of ``reps`` (node, and fingerprints that all differ), which hang together as all near pairs do that share a pair key."""
    parts = partitions(reps.sparkSession)
    prints = reps.select(*PRINT).repartition(parts)  # a row is little to read and much to work on
    total = reps.count() * 120  # about 113 keys a fingerprint
    buckets = min(BUCKETS, max(parts, -(-total // (rows // 2))))
    rows = max(rows, 2 * total // buckets)
    sizes = prints.mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > rows)
    chunks = {r["bucket"]: -(-r["n"] // (rows // 2)) for r in sizes.collect()}  # buckets of twice the usual size: fewer than half of BUCKETS
    units = prints.mapInArrow(_emit(buckets, chunks), "unit long, packed binary").repartition(parts, "unit").sortWithinPartitions("unit")
    found = units.mapInArrow(_compare(limit, order_limit), "a1 long, a2 long, a3 long, b1 long, b2 long, b3 long").distinct()
    for side in "ab":
        ids = reps.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}{c[1]}") for c in PRINT])
        found = found.join(ids, [f"{side}{k}" for k in (1, 2, 3)])
    return found.select("a", "b")


def components(pairs: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """``node, root``: the least node of its component, for each node of a pair with another."""
    edges = written(pairs.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v"))
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # here u > v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, edges = edges, written(small)
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def _classes(docs: DataFrame, text: str, limit: int, order_limit: int) -> DataFrame:
    """``doc_id, h, kept_doc_id, kept_h, n_links, n_copies`` of the rows of each class with several; a row is a doc_id and a text."""
    prints = written(fingerprints(docs, text).distinct())
    reps = written(prints.groupBy(*PRINT).agg(F.min(F.struct("doc_id", "h")).alias("node"), F.count("*").alias("n")))
    roots = components(near_edges(reps, limit, order_limit))
    of = reps.join(roots, "node", "left").select(*PRINT, "n", F.coalesce("root", "node").alias("root"))
    size = of.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("rows")).filter("rows > 1")
    many = of.join(size, "root").select(*PRINT, F.col("root.doc_id").alias("kept_doc_id"), F.col("root.h").alias("kept_h"), (F.col("texts") - 1).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    return prints.join(many, PRINT).drop(*PRINT)


def near_duplicates(docs: DataFrame, text: str = "text", limit: int = LIMIT, order_limit: int = ORDER_LIMIT) -> DataFrame:
    """``doc_id, kept_doc_id, n_links, n_copies`` of each document whose class keeps another, with a smaller doc_id.

    ``kept_doc_id`` names the class; ``n_links`` counts the class's texts that
    differ from the document's, with which it hangs together; ``n_copies`` the other
    documents with its very text.  The classes' kept documents, and documents
    without a near-duplicate, have no row.
    """
    found = _classes(docs, text, limit, order_limit).filter("doc_id <> kept_doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct("kept_doc_id", "n_links", "n_copies")).alias("r")).select("doc_id", "r.*")


def drop_near_duplicates(docs: DataFrame, text: str = "text", limit: int = LIMIT, order_limit: int = ORDER_LIMIT) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one document of each group stays."""
    h, n, gone_id, gone_h = (free_name(docs, x) for x in ("__h", "__n", "__gone_id", "__gone_h"))
    gone = _classes(docs, text, limit, order_limit).filter("doc_id <> kept_doc_id or h <> kept_h").select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h))
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn(h, F.xxhash64(text))
    kept = named.join(gone, (F.col("doc_id") == F.col(gone_id)) & (F.col(h) == F.col(gone_h)), "left_anti")
    once = kept.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(h))).filter(F.col(n) == 1)
    return once.drop(h, n).unionByName(docs.filter(F.col("doc_id").isNull()))
