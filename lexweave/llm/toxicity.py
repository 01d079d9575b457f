"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

A text is judged in windows of ``window`` words, which overlap by half; its score
is that of its worst window, so a long text neither hides an outburst nor adds
up harmless words.  A window's features are its words and their beginnings of 4
to 8 bytes, hashed, each at three levels: there at all, twice or more, four times
or more.  Features count only if they are more frequent in toxic windows than in
those of all documents (every one is counted) by ``z`` standard errors.  On these
a linear classifier is trained with numpy from confirmed toxic documents and
unlabelled ones.  With p the share of toxic documents, R_p+ and R_p- the mean
losses of the toxic ones as positive and as negative, and R_u- that of the
unlabelled ones as negative, the risk is

    p R_p+  +  max(0, R_u- - p R_p-)

whose second part can't fall below zero, which plain PU risk does when it
overfits.  Under logistic loss both parts of the risk, and so the whole, are
convex; the corner at zero is rounded off over ``SMOOTH``, so that the gradient
of all windows leads to the minimum.

Nothing is sampled.  All windows of all rows of ``docs`` whose doc_id is in
``labels`` are trained on: confirmed toxic ones, and as unlabelled all others
(clean ones, and those whose ``toxic`` is null).  Equal windows are counted
together in a table; each of ``steps`` steps sums the gradient over that table
where it lies, in whole multiples of 2**-20, so neither order nor partitions
change the sums.

The threshold is the score that a share of at most ``max_false`` of the clean
documents passes, all of them, each scored by a model that hasn't seen it: they
are dealt to ``FOLDS`` folds by hash, and beside the model of all windows there
is one without each fold, trained in the same steps.

Defined results: null and empty texts have no window and are never flagged;
repeated rows are each answered, and each counted; without a confirmed toxic
document, or without others in ``labels``, nothing is flagged.  A doc_id with
several labels counts as toxic if one says so; labels other than 0 and 1 count
as none.  A doc_id may be of any type.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, id_type, partitions, written
from ._text import Words, find_words, slices

BITS, WINDOW, Z, MAX_FALSE = 18, 400, 6.0, 0.002
#: steps of training and their length, weight decay, rounding of the risk's corner; clean documents' folds
STEPS, RATE, L2, SMOOTH, FOLDS = 60, 0.5, 1e-4, 0.01, 5
#: gradients are summed in units of 1 / UNIT; bits of the map of doc_ids; numbers summed together
UNIT, MAP_BITS, BLOCK = 1 << 20, 26, 1 << 13
PREFIXES = (4, 5, 6, 7, 8)


def word_features(w: Words, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word index, hashed feature) of the words and of each length of beginning."""
    shift = np.uint64(64 - bits)
    yield np.arange(len(w.start)), (w.hashes() >> shift).astype(np.int64)
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        part = Words(w.data, w.start[long], w.start[long] + n, w.off)
        yield long, (part.hashes(n) >> shift).astype(np.int64)


def windows(w: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and the window of each, for each word once, and once more in the windows between; and the text of each window."""
    size = np.diff(w.off)
    doc = w.doc_of()
    at = np.arange(len(w.start)) - w.off[doc]
    per = -(-size // window)
    between = np.where(size > window, -(-(size - window // 2) // window), 0)  # the first begins half a window on
    first = np.concatenate([[0], np.cumsum(per + between)])
    again = np.flatnonzero((between[doc] > 0) & (at >= window // 2))
    word = np.concatenate([np.arange(len(w.start)), again])
    win = np.concatenate([first[doc] + at // window, first[doc[again]] + per[doc[again]] + (at[again] - window // 2) // window])
    return word, win, np.repeat(np.arange(w.n_docs), per + between)


def _keys(w: Words, bits: int, window: int, tells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (window, base feature) as keys, how often each occurs, and the text of each window; only of bases that ``tells`` has."""
    word, win, owner = windows(w, window)
    order = np.argsort(word, kind="stable")
    word, win = word[order], win[order]
    times = np.bincount(word, minlength=len(w.start))
    begin = np.cumsum(times) - times
    keys = [np.zeros(0, np.int64)]
    for i, f in word_features(w, bits):
        if tells is not None:
            hit = tells[f]
            i, f = i[hit], f[hit]
        n = times[i]
        at = np.repeat(begin[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys.append(win[at] << bits | np.repeat(f, n))
    pairs, count = np.unique(np.concatenate(keys), return_counts=True)
    return pairs, count, owner


def features(texts: pa.Array, bits: int = BITS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, feature) pairs, sorted, where a feature is base * 3 + level; and the text of each window."""
    pairs, count, owner = _keys(find_words(texts, lower=True), bits, window)
    row, base = pairs >> bits, pairs & (2**bits - 1)
    parts = [(row[count >= least], base[count >= least] * 3 + level) for level, least in enumerate((1, 2, 4))]
    row, feat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((feat, row))
    return row[order], feat[order], owner


def telling(p_count: np.ndarray, u_count: np.ndarray, n_p: int, n_u: int, z: float) -> np.ndarray:
    """Whether each feature is more frequent in the positive windows by ``z`` standard errors."""
    n_p, n_u = max(1, n_p), max(1, n_u)
    p, u = p_count / n_p, (u_count + 1) / (n_u + 2)
    return p - u > z * np.sqrt(u * (1 - np.minimum(u, 0.999)) * (1 / n_p + 1 / n_u))


def risk_gradient(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Non-negative risk of scores ``z`` under logistic loss, and its gradient by ``z`` (of the negative part alone where that is below zero, reversed)."""
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    as_pos, as_neg = np.logaddexp(0, -z), np.logaddexp(0, z)
    part = as_neg[~positive].sum() / n_u - prior * as_neg[positive].sum() / n_p
    g_neg = np.where(positive, -prior / n_p, 1 / n_u) * s
    risk = prior * as_pos[positive].sum() / n_p + max(0.0, part)
    if part < 0:
        return risk, -g_neg
    return risk, g_neg + np.where(positive, prior / n_p * (s - 1), 0.0)


def pull(part: float, smooth: float = SMOOTH) -> float:
    """Slope of the risk's second part, ``smooth * log(1 + exp(part / smooth))``, at ``part``."""
    return 1 / (1 + math.exp(-min(max(part / smooth, -500.0), 500.0)))


POSITIVE, UNLABELLED, CLEAN = 0, 1, 2  # CLEAN + k: of fold k


def known_documents(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``doc_id, kind`` of all labelled documents that there are, and the share of toxic ones among those labelled 0 or 1."""
    value = F.when(F.col("toxic").isin(0, 1), F.col("toxic"))
    ids, said = docs.select("doc_id").distinct(), labels.select(F.col("doc_id").alias("of"), value.alias("toxic"))
    known = ids.join(said, ids.doc_id == said.of).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # ids as ``docs`` has them, since hashes differ by type
    kind = F.when(F.col("toxic") == 1, POSITIVE).when(F.col("toxic") == 0, CLEAN + _fold()).otherwise(UNLABELLED)
    known = written(known.select("doc_id", kind.cast("int").alias("kind")))
    n, t = known.filter(f"kind <> {UNLABELLED}").agg(F.count("*"), F.count(F.when(F.col("kind") == POSITIVE, 1))).first()
    return known, float(t) / n if n else 0.0


def _fold():
    return F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))


def _place():
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS))


def id_map(ids: DataFrame) -> np.ndarray:
    """2**MAP_BITS bits, of which those of the ``ids`` are set."""
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    got = ids.select(_place().alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2**MAP_BITS / 64 rows at most
    out = np.zeros((1 << MAP_BITS) // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out


def _candidates(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows whose place is set: all of the ids, and a few more, which the join that follows takes out.  Without it, that would shuffle all texts."""
    for b in batches:
        at = b.column("place").to_numpy()
        yield b.filter(pa.array(bits[at >> 6] >> (at & 63) & 1 == 1))


def evenly(row: np.ndarray, feat: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with at most ``most`` windows a text, evenly spaced."""
    n = np.bincount(owner)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    few = np.minimum(n, most)[owner]
    keep = (at * few // n[owner]) != ((at - 1) * few // n[owner])
    new = np.cumsum(keep) - 1
    mine = keep[row]
    return new[row[mine]], feat[mine], owner[keep]


def _totals(bits: int, window: int):
    """In how many windows each feature stands; the last: how many windows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 * 2**bits + 1, np.int64)
        for b in slices(batches, "text"):
            _, feat, owner = features(b.column("text"), bits, window)
            total[:-1] += np.bincount(feat, minlength=3 * 2**bits)
            total[-1] += len(owner)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["feat", "n"])

    return run


def _frequencies(texts: DataFrame, bits: int, window: int) -> tuple[np.ndarray, int]:
    got = texts.select("text").mapInArrow(_totals(bits, window), "feat int, n long").groupBy("feat").agg(F.sum("n").alias("n")).toArrow()  # 3 * 2**bits numbers at most
    out = np.zeros(3 * 2**bits + 1, np.int64)
    out[got.column("feat").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _texts_of(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """The rows of ``docs`` with one of ``ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(id_map(ids))  # 2**MAP_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _candidates(batches, shared.value):
            yield b.select(["doc_id", "text"])

    rows = docs.select("doc_id", F.col(text).alias("text"), _place().alias("place")).filter("doc_id is not null")
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, text string").join(ids, "doc_id", "left_semi")


def window_table(docs: DataFrame, known: DataFrame, text: str, names: np.ndarray, bits: int, window: int) -> DataFrame:
    """``kind, feats, n``: how often a window with just these of the features ``names`` (their numbers, as int32) stands in documents of a kind."""
    shared = docs.sparkSession.sparkContext.broadcast((id_map(known), names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, names = shared.value
        tells = np.zeros(2**bits, bool)
        tells[names // 3] = True
        number = np.full(3 * 2**bits, -1, np.int32)
        number[names] = np.arange(len(names))
        for b in slices(_candidates(batches, bitmap), "text"):
            pairs, count, owner = _keys(find_words(b.column("text"), lower=True), bits, window, tells)
            row = np.repeat(pairs >> bits, 3)
            level = np.tile(np.arange(3), len(pairs))
            feat = number[np.repeat(pairs & (2**bits - 1), 3) * 3 + level]
            hit = (feat >= 0) & (np.repeat(count, 3) >= 1 << level)
            row, feat = row[hit], feat[hit]
            cut = (np.searchsorted(row, np.arange(len(owner) + 1)) * 4).astype(np.int32)
            feats = pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(feat))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), feats], ["doc_id", "feats"])

    rows = docs.select("doc_id", F.col(text).alias("text"), _place().alias("place")).filter("doc_id is not null")
    rows = rows.mapInArrow(run, f"doc_id {id_type(docs)}, feats binary").join(known, "doc_id")
    return written(rows.groupBy("kind", "feats").agg(F.count("*").alias("n")).repartition(partitions(docs.sparkSession), "feats"))  # files enough for all tasks


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) pairs of a batch of :func:`window_table`, sorted; kind and number of each row."""
    feats = batch.column("feats").cast(pa.large_binary())
    cut = np.frombuffer(feats.buffers()[1], np.int64)[feats.offset : feats.offset + len(feats) + 1] // 4
    data = feats.buffers()[2]
    feat = np.frombuffer(data, np.int32)[cut[0] : cut[-1]] if data is not None and cut[-1] > cut[0] else np.zeros(0, np.int32)
    return np.repeat(np.arange(len(feats)), np.diff(cut)), feat, batch.column("kind").to_numpy(), batch.column("n").to_numpy()


def sums(row: np.ndarray, feat: np.ndarray, kind: np.ndarray, n: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each model, of the positive windows and of the unlabelled ones that it sees: the sum over each feature's windows of the loss's slope, that over all windows, and the loss; in units of 1 / UNIT."""
    m = w.shape[1]
    out = np.zeros((len(w), 2, m + 2))
    side = (kind != POSITIVE).astype(np.int64)
    at = feat + side[row] * m
    for j in range(len(w)):
        z = np.bincount(row, w[j][feat], minlength=len(kind)) + b[j]
        e = np.exp(-np.abs(z))
        seen = n * (kind != CLEAN + j)
        slope = np.rint(UNIT * np.where(z > 0, 1, e) / (1 + e)) * seen  # whole numbers, which add up exactly
        loss = np.rint(UNIT * (np.maximum(z, 0) + np.log1p(e))) * seen
        out[j, :, :-2] = np.bincount(at, slope[row], minlength=2 * m).reshape(2, m)
        out[j, :, -2] = np.bincount(side, slope, minlength=2)
        out[j, :, -1] = np.bincount(side, loss, minlength=2)
    return out


def _summed(shared, shape: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        total = np.zeros(shape, np.int64)
        for batch in batches:
            total += sums(*unpack(batch), w, b).astype(np.int64)
        blocks = np.array_split(total.ravel(), -(-total.size // BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([x.tobytes() for x in blocks], pa.binary())], ["block", "s"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("block").to_pylist(), batch.column("s").to_pylist(), strict=True):
            mine = np.frombuffer(x, np.int64)
            total[k] = total[k] + mine if k in total else mine
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "s"])


def train(table: DataFrame, p_count: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the models without each fold and, last, of the whole one, by Adagrad on the gradient of all windows; ``p_count``: positive windows of each feature."""
    sc = table.sparkSession.sparkContext
    size = dict(table.groupBy("kind").agg(F.sum("n")).collect())
    n_p, n_rest = size.get(POSITIVE, 0), sum(v for k, v in size.items() if k != POSITIVE)
    n_u = np.maximum(1, [n_rest - size.get(CLEAN + j, 0) for j in range(FOLDS)] + [n_rest])
    w, b = np.zeros((FOLDS + 1, len(p_count))), np.zeros(FOLDS + 1)
    gw, gb = np.full(w.shape, 1e-8), np.full(len(b), 1e-8)
    if not n_p or not n_rest:
        return w, b
    shape = (len(w), 2, w.shape[1] + 2)
    for _ in range(steps):
        shared = sc.broadcast((w, b))
        got = table.mapInArrow(_summed(shared, shape), "block int, s binary").repartition("block").mapInArrow(_added, "block int, s binary").toArrow()  # two numbers a feature and model
        total = np.frombuffer(b"".join(x for _, x in sorted(zip(got.column("block").to_pylist(), got.column("s").to_pylist(), strict=True))), np.int64) / UNIT
        shared.destroy()
        grad, grad_b = gradient(total.reshape(shape), p_count, prior, n_p, n_u)
        grad += l2 * w
        gw += grad**2
        gb += grad_b**2
        w = np.maximum(0, w - rate / np.sqrt(gw) * grad)  # what tells can only add to a score
        b = b - rate / np.sqrt(gb) * grad_b
    return w, b


def gradient(total: np.ndarray, p_count: np.ndarray, prior: float, n_p: int, n_u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the risk by weights and bias, from :func:`sums`."""
    q = np.array([pull(x) for x in total[:, 1, -1] / n_u - prior * total[:, 0, -1] / n_p])
    all_p = np.append(p_count, n_p)
    g = prior / n_p * ((1 - q)[:, None] * total[:, 0, :-1] - all_p) + (q / n_u)[:, None] * total[:, 1, :-1]
    return g[:, :-1], g[:, -1]


def fit(docs: DataFrame, known: DataFrame, share: float, text: str = "text", prior: float | None = None, bits: int = BITS, window: int = WINDOW, z: float = Z, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the features that tell; their weights and the biases of the models without each fold and, last, of the whole one."""
    prior = share if prior is None else prior
    p_count, n_p = _frequencies(_texts_of(docs, known.filter(f"kind = {POSITIVE}").select("doc_id"), text), bits, window)
    u_count, n_u = _frequencies(docs.select(F.col(text).alias("text")), bits, window)
    names = np.flatnonzero(telling(p_count, u_count, n_p, n_u, z))
    table = window_table(docs, known, text, names, bits, window)
    w, b = train(table, p_count[names], prior, steps)
    discard(table)
    return names, w, b


class Scorer:
    """Weights summed over the levels, of the features' bases that tell."""

    def __init__(self, names: np.ndarray, w: np.ndarray, b: np.ndarray, bits: int, window: int):
        self.bits, self.window, self.b = bits, window, b
        self.bases = np.unique(names // 3)
        full = np.zeros((len(w), len(self.bases), 3))
        full[:, np.searchsorted(self.bases, names // 3), names % 3] = w
        self.total = np.cumsum(full, axis=2).astype(np.float32)

    def scores(self, texts: pa.Array, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text's worst window by the whole model, and by that without its fold; -inf for a text without words."""
        tells = np.zeros(2**self.bits, bool)
        tells[self.bases] = True
        w = find_words(texts, lower=True)
        pairs, count, owner = _keys(w, self.bits, self.window, tells)
        level = (count >= 2).astype(int) + (count >= 4)
        row, base = pairs >> self.bits, np.searchsorted(self.bases, pairs & (2**self.bits - 1))
        out = []
        for model in (np.full(len(owner), len(self.b) - 1), fold[owner]):
            each = np.bincount(row, self.total[model[row], base, level], minlength=len(owner)) + self.b[model]
            worst = np.full(w.n_docs, -np.inf)
            np.maximum.at(worst, owner, each)
            out.append(worst)
        return out[0], out[1]


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the floating-point ones."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def unordered(key: int) -> float:
    return float(np.array([key ^ (2**63 - 1) if key < 0 else key], np.int64).view(np.float64)[0])


def at_rank(keys: DataFrame, rank: int) -> int:
    """The number of ``key`` of this rank, from 0: 16 bits at a time, so that no more than 65,536 counts come to the driver."""
    high = 0
    for shift in (48, 32, 16, 0):
        part = keys if shift == 48 else keys.filter(F.shiftright("key", shift + 16) == high)
        for at, n in sorted(part.groupBy(F.shiftright("key", shift).alias("at")).count().collect()):
            if rank < n:
                high = at
                break
            rank -= n
    return high


def cutoff(keys: DataFrame, max_false: float) -> float:
    """The least score that a share of at most ``max_false`` of the scores behind the keys passes; 0 at least."""
    n = keys.count()
    return max(0.0, unordered(at_rank(keys, math.ceil((n - 1) * (1 - max_false))))) if n else 0.0


def flag_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", max_false: float = MAX_FALSE, bits: int = BITS, window: int = WINDOW, **options) -> DataFrame:
    """``doc_id, score`` of each row of ``docs`` whose score is above the threshold."""
    spark = docs.sparkSession
    known, share = known_documents(docs, labels)
    if known.filter(f"kind = {POSITIVE}").isEmpty() or known.filter(f"kind <> {POSITIVE}").isEmpty():
        return spark.createDataFrame([], f"doc_id {id_type(docs)}, score double")
    names, w, b = fit(docs, known, share, text, bits=bits, window=window, **options)
    model = spark.sparkContext.broadcast(Scorer(names, w, b, bits, window))  # 3 * 2**bits numbers a model at most, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            score, unseen = model.value.scores(part.column("text"), part.column("fold").to_numpy())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(ordered(unseen))], ["doc_id", "score", "key"])

    scored = written(docs.select("doc_id", F.col(text).alias("text"), _fold().alias("fold")).mapInArrow(run, f"doc_id {id_type(docs)}, score double, key long"))
    keys = written(scored.join(known.filter(f"kind >= {CLEAN}"), "doc_id", "left_semi").select("key"))
    threshold = cutoff(keys, max_false)
    discard(keys)
    discard(known)
    return scored.filter(F.col("score") > threshold).select("doc_id", "score")
