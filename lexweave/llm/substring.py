"""Substring dedup with fixed-block anchors.

Words are runs of anything but white space, compared as they are.  Every
document is cut into reference blocks of ``block`` words that don't overlap; the
earliest block of each content, by (doc_id, position), is its anchor.  Every
rolling window of ``block`` words of every document probes the blocks, and a
window that equals an anchor before it is a hit.  Hits of a document on one
anchor document at the same displacement join to runs, and each run is extended
word by word each way until a word differs, to the maximal exact repeat: first
by a block less one word, then, where all of these are equal (as the blocks
beyond have their anchors elsewhere), by ever longer stretches.

Any passage of ``2 * block - 1`` words holds a whole block of its earlier
occurrence.  If all
blocks of that content have the same words beside them, the anchor does for all.
A content whose blocks differ in them is *mixed*: the passage may go on as
another block of it does, not as the anchor.  So all windows of
``2 * block - 1`` words that hold a window of a mixed content are compared with
each other as well, and each that stood before is a hit on its earliest
occurrence.  Thus no passage of ``2 * block - 1`` words is missed.

Reported are the repeats that lie in stretches of at least ``min_words`` words,
a stretch being repeats of a document that overlap or touch.

Windows travel packed: all windows of a batch that fall in one hash bucket are
one row of byte planes (5 bytes of hash, then document and position as steps),
about 7 bytes a window.  Each bucket keeps its blocks in memory and streams
its windows.  Blocks also carry a second hash of 64 bits, so that contents whose
40 bits agree keep an anchor each; a window hits all of them, and runs are then
compared by a second hash of all their words, and extended by 64-bit word hashes.

Defined results: null and empty texts and null doc_ids have no repeats (and
stay, in :func:`cut_repeats`); within one document a repeat must not overlap its
anchor; rows that repeat a doc_id are one document, the first by text.  The
earliest occurrence always stays.  doc_ids must be integers, whose order says
what is earlier.  Other columns are ignored, or passed on, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import discard, free_name, partitions, written
from ._text import NONSPACE, find_words, mix, prefix_hash, slices, span_hash

BLOCK, MIN_WORDS, BATCH = 25, 50, 4 << 20
LOW40 = np.uint64((1 << 40) - 1)
SECOND = np.uint64(0x1F83D9ABFB41BD6B)


def beside(g: np.ndarray, inv: np.ndarray, start: np.ndarray, block: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words beside each block, a block less one each way, and of how many there are."""
    a, e = np.maximum(lo, start - block + 1), np.minimum(hi, start + 2 * block - 1)
    size = ((start - a) << 32 | (e - start)).astype(np.uint64)
    return mix(span_hash(g, inv, a, e) ^ mix(size))


def pack(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Byte planes of hashes (low 40 bits), documents and positions, in order of document and position."""
    n = len(h)
    d = np.diff(doc, prepend=0)
    p = np.where(d == 0, np.diff(pos, prepend=0), pos).astype("<u4")
    planes = [(h & LOW40).astype("<u8").view(np.uint8).reshape(n, 8)[:, :5].tobytes(), np.ascontiguousarray(d.astype("<u4").view(np.uint8).reshape(n, 4).T).tobytes(), np.ascontiguousarray(p.view(np.uint8).reshape(n, 4).T).tobytes()]
    return b"".join(planes)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    n = len(b) // 13
    h = np.zeros((n, 8), np.uint8)
    h[:, :5] = b[: 5 * n].reshape(n, 5)
    d = np.ascontiguousarray(b[5 * n : 9 * n].reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    p = np.ascontiguousarray(b[9 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    new = d != 0
    new[:1] = True
    first = np.flatnonzero(new)
    total = np.cumsum(p)
    base = np.where(first > 0, total[first - 1], 0)
    return h.view("<u8").ravel(), np.cumsum(d), total - np.repeat(base, np.diff(np.append(first, n)))


def _emit(parts: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH):
            w = find_words(b.column("text"), NONSPACE)
            n_words = np.diff(w.off)
            has = np.maximum(0, n_words - block + 1)
            if not has.any():
                continue
            g, inv = prefix_hash(w.hashes())
            doc = np.repeat(np.arange(w.n_docs), has)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(has) - has, has)
            start = w.off[doc] + pos
            h = span_hash(g, inv, start, start + block)
            bucket = (h >> np.uint64(40)).astype(np.int64) % parts
            ids = b.column("doc_id").to_numpy()
            cuts = np.flatnonzero(pos % block == 0)
            # of a block: the hash of the words beside it, and the second hash of its own
            around = np.empty((len(cuts), 2), np.uint64)
            around[:, 0] = beside(g, inv, start[cuts], block, w.off[doc[cuts]], w.off[doc[cuts] + 1])
            g = prefix_hash(mix(w.hashes() ^ SECOND))[0]
            around[:, 1] = span_hash(g, inv, start[cuts], start[cuts] + block)
            del g, inv, start
            rows: list[tuple] = []
            for kind, sel in ((0, cuts), (1, None)):
                bk = bucket if sel is None else bucket[sel]
                order = np.argsort(bk.astype(np.int32), kind="stable")
                cut = np.searchsorted(bk[order], np.arange(parts + 1))
                if sel is not None:
                    order = sel[order]
                for k in np.flatnonzero(np.diff(cut)):
                    i = order[cut[k] : cut[k + 1]]
                    docs, local = np.unique(doc[i], return_inverse=True)
                    rows.append((int(k), kind, ids[docs].tobytes(), pack(h[i], local, pos[i]), b"" if sel is None else around[np.searchsorted(sel, i)].tobytes()))
                    if len(rows) >= 256:
                        yield _packed(rows)
                        rows = []
            if rows:
                yield _packed(rows)

    return run


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary())], ["bucket", "kind", "docs", "packed", "around"])


def _decode(docs: bytes, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, local, pos = unpack(raw)
    return h, np.frombuffer(docs, np.int64)[local], pos


def _probe(block: int):
    """Hits of windows on anchors; and windows of a mixed content, which have no ``ref``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple] = []
        index = None
        for b in batches:
            for kind, docs, raw, around in zip(b.column("kind").to_pylist(), b.column("docs").to_pylist(), b.column("packed").to_pylist(), b.column("around").to_pylist(), strict=True):
                part = _decode(docs, raw)
                if kind == 0:
                    blocks.append((*part, np.frombuffer(around, np.uint64).reshape(-1, 2)))
                    continue
                if index is None and blocks:
                    h, d, p, c = (np.concatenate([x[i] for x in blocks]) for i in range(4))
                    order = np.lexsort((p, d, c[:, 1], h))
                    h, d, p, c = h[order], d[order], p[order], c[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (c[1:, 1] != c[:-1, 1])
                    cut = np.flatnonzero(new)
                    differs = c[:, 0] != np.repeat(c[cut, 0], np.diff(np.append(cut, len(h))))
                    index = h[cut], d[cut], p[cut], np.maximum.reduceat(differs, cut)
                    blocks = []
                if index is not None and len(part[0]):
                    low, high = np.searchsorted(index[0], part[0]), np.searchsorted(index[0], part[0], side="right")
                    many = high - low
                    which = np.repeat(np.arange(len(many)), many)  # a window and each anchor of its 40 bits
                    at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(which))
                    doc, pos, ref, rpos = part[1][which], part[2][which], index[1][at], index[2][at]
                    hit = np.flatnonzero((ref < doc) | (ref == doc) & (rpos + block <= pos))
                    mixed = np.flatnonzero(index[3][at])
                    if len(hit) or len(mixed):
                        both = np.concatenate([hit, mixed])
                        none = np.arange(len(both)) >= len(hit)
                        yield pa.RecordBatch.from_arrays([pa.array(doc[both]), pa.array(pos[both].astype(np.int32)), pa.array(ref[both], mask=none), pa.array(rpos[both].astype(np.int32), mask=none)], ["doc", "pos", "ref", "rpos"])

    return run


def _emit_long(parts: int, block: int):
    """The windows of ``2 * block - 1`` words that hold a window of a mixed content (``want``: where these begin)."""
    size = 2 * block - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", BATCH):
            w = find_words(b.column("text"), NONSPACE)
            g, inv = prefix_hash(w.hashes())
            want = b.column("want")
            cut = np.asarray(want.offsets)
            at = want.values.slice(cut[0], cut[-1] - cut[0]).to_numpy().astype(np.int64) + np.repeat(w.off[:-1], np.diff(cut))
            diff = np.zeros(len(w.start) + 1, np.int64)
            owner = np.repeat(np.arange(w.n_docs), np.diff(cut))
            np.add.at(diff, np.maximum(w.off[owner], at - block + 1), 1)
            np.add.at(diff, at + 1, -1)
            start = np.flatnonzero(np.cumsum(diff)[:-1] > 0)
            doc = np.searchsorted(w.off, start, side="right") - 1
            fits = start + size <= w.off[doc + 1]
            start, doc = start[fits], doc[fits]
            h = span_hash(g, inv, start, start + size)
            bucket = (h >> np.uint64(40)).astype(np.int64) % parts
            ids = b.column("doc_id").to_numpy()
            order = np.argsort(bucket.astype(np.int32), kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(parts + 1))
            rows: list[tuple] = []
            for k in np.flatnonzero(np.diff(cut)):
                i = order[cut[k] : cut[k + 1]]
                docs, local = np.unique(doc[i], return_inverse=True)
                rows.append((int(k), 1, ids[docs].tobytes(), pack(h[i], local, start[i] - w.off[doc[i]]), b""))
                if len(rows) >= 256:
                    yield _packed(rows)
                    rows = []
            if rows:
                yield _packed(rows)

    return run


def _probe_long(block: int):
    """Each long window that stood before, as hits of its two blocks' length on the earliest occurrence."""
    size = 2 * block - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        for b in batches:
            got += [_decode(docs, raw) for docs, raw in zip(b.column("docs").to_pylist(), b.column("packed").to_pylist(), strict=True)]
        if not got:
            return
        h, d, p = (np.concatenate([x[i] for x in got]) for i in range(3))
        got.clear()
        order = np.lexsort((p, d, h))
        h, d, p = h[order], d[order], p[order]
        cut = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint64(1)))
        n = np.diff(np.append(cut, len(h)))
        ref, rpos = np.repeat(d[cut], n), np.repeat(p[cut], n)
        hit = np.flatnonzero((ref < d) | (ref == d) & (rpos + size <= p))
        for i in range(0, len(hit), 1 << 18):
            x = hit[i : i + (1 << 18)]
            ends = [np.concatenate([a[x], a[x] + size - block]).astype(np.int32) for a in (p, rpos)]  # windows of a block at both ends
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(d[x], 2)), pa.array(ends[0]), pa.array(np.tile(ref[x], 2)), pa.array(ends[1])], ["doc", "pos", "ref", "rpos"])

    return run


def _runs(block: int):
    """Spans of hits, sorted by document, ref, shift and position, that follow each other within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last span so far
        for b in batches:
            if not b.num_rows:
                continue
            doc, ref, shift, pos = (b.column(c).to_numpy().astype(np.int64) for c in ("doc", "ref", "shift", "pos"))
            end = pos + block
            if held is not None:
                doc, ref, shift, pos, end = (np.concatenate([[x], y]) for x, y in zip(held, (doc, ref, shift, pos, end), strict=True))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1]) | (pos[1:] > end[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            spans = doc[first], ref[first], shift[first], pos[first], end[last]
            held = tuple(int(x[-1]) for x in spans)
            yield _spans([x[:-1] for x in spans])
        if held is not None:
            yield _spans([np.array([x]) for x in held])

    return run


def _spans(x: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2].astype(np.int32)), pa.array(x[3].astype(np.int32)), pa.array(x[4].astype(np.int32))], ["doc", "ref", "shift", "s", "e"])


def _contexts(reach: int):
    """For each wanted (start, end) of a text: the hash of its words and the ``reach`` word hashes before and after it, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = find_words(b.column("text"), NONSPACE)
            h = w.hashes()
            g, inv = prefix_hash(mix(h ^ SECOND))
            want = b.column("want")
            cut = np.asarray(want.offsets)
            flat = want.values.slice(cut[0], cut[-1] - cut[0])
            start, end = (flat.field(i).to_numpy().astype(np.int64) for i in range(2))
            doc = np.repeat(np.arange(b.num_rows), np.diff(cut))
            lo, hi = w.off[doc], w.off[doc + 1]
            digest = span_hash(g, inv, np.minimum(lo + start, hi), np.minimum(lo + end, hi))
            n_left, n_right = np.minimum(start, reach), np.clip(hi - lo - end, 0, reach)

            def lists(n: np.ndarray, at) -> pa.Array:
                off = np.concatenate([[0], np.cumsum(n)])
                step = np.arange(off[-1]) - np.repeat(off[:-1], n)
                return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h[at(step, n)].view(np.int64)))

            left = lists(n_left, lambda step, n: np.repeat(lo + start, n) - 1 - step)  # noqa: B023
            right = lists(n_right, lambda step, n: np.repeat(lo + end, n) + step)  # noqa: B023
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), flat.field(2), flat.field(3), pa.array(digest.view(np.int64)), left, right], ["doc", "s", "e", "ref", "shift", "digest", "before", "after"])

    return run


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays share from their beginning."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")



def _first_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of each document: of rows that repeat a doc_id the first by text.  Only doc_ids are exchanged where none repeats."""
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = rows.groupBy("doc_id").count().filter("count > 1")
    return rows if twice.isEmpty() else rows.groupBy("doc_id").agg(F.min("text").alias("text"))


def repeats(docs: DataFrame, block: int = BLOCK, min_words: int = MIN_WORDS, parts: int | None = None, maximal: bool = True) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, ref_doc_id, ref_start_word, stretch_start, stretch_end`` of each repeat.

    The stretches are the same without ``maximal``, since every block of a repeat
    has a hit of its own; then rows may end where a block has its anchor elsewhere.
    """
    parts = parts or partitions(docs.sparkSession)
    rows = _first_rows(docs)
    planes, hit = "bucket int, kind int, docs binary, packed binary, around binary", "doc long, pos int, ref long, rpos int"
    packed = rows.mapInArrow(_emit(parts, block), planes)
    probed = written(packed.repartitionById(parts, "bucket").sortWithinPartitions("kind").mapInArrow(_probe(block), hit))
    mixed = probed.filter("ref is null").groupBy(F.col("doc").alias("of")).agg(F.collect_list("pos").alias("want"))
    longer = rows.join(mixed, F.col("doc_id") == F.col("of")).select("doc_id", "text", "want").mapInArrow(_emit_long(parts, block), planes)
    hits = probed.filter("ref is not null").unionByName(longer.repartitionById(parts, "bucket").mapInArrow(_probe_long(block), hit))

    # what follows is within a document: one exchange by doc serves it
    lines = hits.withColumn("shift", F.col("pos") - F.col("rpos")).select("doc", "ref", "shift", "pos").repartition("doc").sortWithinPartitions("doc", "ref", "shift", "pos")
    spans = written(lines.mapInArrow(_runs(block), "doc long, ref long, shift int, s int, e int"))
    discard(probed)
    whole, reach = [], block - 1
    texts = _by_document(rows, parts)
    while True:
        grown = written(_extended(texts, spans, reach))
        discard(spans)
        whole.append(grown.filter("not more").drop("more"))
        spans = grown.filter("more").drop("more")
        if not maximal or spans.isEmpty():
            whole.append(spans)
            break
        spans, reach, texts = written(spans), 8 * reach, rows  # few are left: their texts needn't be exchanged
    exact = functools.reduce(DataFrame.unionByName, whole).repartition("doc")

    def merged(df: DataFrame, keys: list[str], name: str, touch: int) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy("s", "e")
        sofar = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(name, F.sum((F.col("s") > F.coalesce(sofar, F.lit(-1)) + touch - 1).cast("int")).over(by))

    whole = merged(exact, ["doc", "ref", "shift"], "n", 1).groupBy("doc", "ref", "shift", "n").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("n")
    stretch = Window.partitionBy("doc", "n")
    out = merged(whole, ["doc"], "n", 1).withColumn("ss", F.min("s").over(stretch)).withColumn("se", F.max("e").over(stretch)).filter(F.col("se") - F.col("ss") >= min_words)
    return out.select(F.col("doc").alias("doc_id"), F.col("s").alias("start_word"), F.col("e").alias("end_word"), (F.col("e") - F.col("s")).alias("n_words"), F.col("ref").alias("ref_doc_id"), (F.col("s") - F.col("shift")).alias("ref_start_word"), F.col("ss").alias("stretch_start"), F.col("se").alias("stretch_end"))


def _extended(texts: DataFrame, spans: DataFrame, reach: int) -> DataFrame:
    """The ``spans`` whose words are equal, longer by what is equal within ``reach`` words each way; ``more``: whether all of these are, on a side."""
    own = _asked(texts, spans.select(F.col("doc").alias("at"), "s", "e", "ref", "shift"), reach)
    # of an anchor each span is asked for once, however many documents repeat it
    anchors = spans.select(F.col("ref").alias("at"), (F.col("s") - F.col("shift")).alias("s"), (F.col("e") - F.col("shift")).alias("e")).distinct()
    theirs = _asked(texts, anchors.select("at", "s", "e", F.lit(None).cast("long").alias("ref"), F.lit(0).alias("shift")), reach)
    theirs = theirs.select(F.col("doc").alias("ref"), F.col("s").alias("rs"), F.col("e").alias("re"), F.col("digest").alias("digest1"), F.col("before").alias("before1"), F.col("after").alias("after1"))
    both = own.withColumns({"rs": F.col("s") - F.col("shift"), "re": F.col("e") - F.col("shift")}).join(theirs, ["ref", "rs", "re"]).filter("digest = digest1")
    found = both.select("doc", "ref", "shift", "s", "e", _common(F.col("before"), F.col("before1")).alias("left"), _common(F.col("after"), F.col("after1")).alias("right"))
    # within one document the anchor ends where the repeat begins
    room = F.when(F.col("doc") == F.col("ref"), F.greatest(F.lit(0), F.col("s") - F.col("left") - (F.col("e") - F.col("shift")))).otherwise(F.col("right"))
    more = (F.col("left") == reach) | (F.col("right") == reach) & (room >= F.col("right"))
    return found.select("doc", "ref", "shift", (F.col("s") - F.col("left")).alias("s"), (F.col("e") + F.least("right", room)).alias("e"), more.alias("more"))


def _asked(texts: DataFrame, spans: DataFrame, reach: int) -> DataFrame:
    wanted = spans.groupBy("at").agg(F.collect_list(F.struct("s", "e", "ref", "shift")).alias("want"))
    return texts.join(wanted, F.col("doc_id") == F.col("at")).drop("at").mapInArrow(_contexts(reach), "doc long, s int, e int, ref long, shift int, digest long, before array<long>, after array<long>")


def _by_document(docs: DataFrame, parts: int) -> DataFrame:
    """The documents by doc_id, so that several joins share one exchange."""
    return docs.repartition(parts, "doc_id")


def cut_repeats(docs: DataFrame, block: int = BLOCK, min_words: int = MIN_WORDS, parts: int | None = None) -> DataFrame:
    """``docs``, with all their columns, without the stretches that repeat earlier text; ``n_chars`` is set anew, and a document of which nothing is left goes."""
    parts = parts or partitions(docs.sparkSession)
    cut_id, cut, first = (free_name(docs, x) for x in ("__id", "__cut", "__first"))
    cuts = repeats(docs, block, min_words, parts, maximal=False).groupBy("doc_id").agg(F.collect_set(F.struct(F.col("stretch_start").alias("s"), F.col("stretch_end").alias("e"))).alias(cut)).withColumnRenamed("doc_id", cut_id)
    same = F.col("doc_id") == F.col(cut_id)
    rows = docs.filter("doc_id is not null and text is not null")
    twice = rows.groupBy("doc_id").count().filter("count > 1")
    if not twice.isEmpty():  # the spans are those of the first text
        of = free_name(docs, "__of")
        texts = rows.groupBy("doc_id").agg(F.min("text").alias(first)).withColumnRenamed("doc_id", of)
        cuts = cuts.join(texts, F.col(cut_id) == F.col(of)).drop(of)
        same = same & (F.col("text") == F.col(first))
    with_id = docs.filter(F.col("doc_id").isNotNull())
    joined = _by_document(with_id, parts).join(cuts, same, "left").drop(cut_id)
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans_of, keep = b.column("text").to_pylist(), b.column(cut).to_pylist(), []
            chars = b.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, spans in enumerate(spans_of):
                left = True
                if spans:
                    texts[i] = without(texts[i], sorted((x["s"], x["e"]) for x in spans))
                    left = bool(texts[i].strip())
                    if chars is not None:
                        chars[i] = len(texts[i])
                keep.append(left)
            cols = []
            for f in b.schema:
                if f.name == cut:
                    continue
                new = {"text": texts, "n_chars": chars}.get(f.name)
                cols.append(b.column(f.name) if new is None else pa.array(new, f.type))
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

    return joined.select(*names, cut).mapInArrow(run, schema).unionByName(docs.filter(F.col("doc_id").isNull()))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans, and without the blanks after them."""
    w = find_words(pa.array([text]), NONSPACE)
    raw = w.data.tobytes()
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : w.start[s]])
        at = max(at, w.start[e] if e < len(w.start) else len(raw))
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")
