import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import decontam as D
from lexweave.llm._text import find_words

from .common import documents, text, with_clashes, words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequence_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 70))], [rng.choice("abcdefghxy") for _ in range(rng.randint(0, 60))]
        items = D.Items([(1, " ".join(a))])
        h = find_words(pa.array([" ".join(b)])).hashes().tolist()
        assert items.matched(0, h).bit_count() == lcs(a, b)


def test_products_and_frequencies_against_the_matrix_of_passages():
    rng = random.Random(1)
    texts = pa.array([text(rng, n) for n in (3, 16, 17, 40, 8, 100)] + [None, ""])
    w, passage, bits = find_words(texts, lower=True), 16, 6
    term, a = D.terms_of(w.hashes(), bits), []
    for d in range(w.n_docs):
        mine = term[w.off[d] : w.off[d + 1]]
        for k in range(max(1, -(-len(mine) // 8) - 1) if len(mine) else 0):
            a.append(np.bincount(mine[k * 8 : k * 8 + 16], minlength=64))
    a = np.array(a)
    df, n = D.passage_frequencies(w, passage, bits)
    assert n == len(a) and (df == (a > 0).sum(axis=0)).all()
    m, total = np.random.default_rng(1).standard_normal((64, 5)).astype(np.float32), np.zeros((64, 5))
    D.product(w, passage, m, total)
    assert np.allclose(total, a.T @ (a @ m), atol=1e-2)


def test_sums_without_sorting_and_reduceat_are_the_same():
    rng = np.random.default_rng(7)
    place, term = np.sort(rng.integers(0, 500, 4000)), rng.integers(0, 64, 4000) ** 2 // 64
    for bits in (6, 20):
        assert (D.distinct(term, place, 501, bits) == np.unique(term * 501 + place)).all()
    assert len(D.distinct(term[:0], place[:0], 501, 6)) == 0
    m = rng.standard_normal((64, 5)).astype(np.float32)
    for size in ([32] * 50 + [3, 32, 1], [1], [7, 7], [1] * 40 + [900]):
        start = np.concatenate([[0], np.cumsum(size)])
        rows = m[term[: start[-1]]]
        want = np.add.reduceat(rows.astype(float), start[:-1], axis=0)
        assert np.allclose(D.half_sums(term, start, m), want, atol=1e-3) and np.allclose(D.run_sums(rows, start[:-1]), want, atol=1e-3)


def test_singular_vectors_against_svd():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((300, 8)) @ rng.standard_normal((8, 50))
    g = rng.standard_normal((50, 20))
    v = D.singular_vectors(a.T @ (a @ g), g, 8)
    want = np.linalg.svd(a, full_matrices=False)[2][:8].T
    assert np.allclose(v @ v.T, want @ want.T, atol=1e-2)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    items = [(i, f"{text(rng, 20).capitalize()}. {text(rng, 10).capitalize()}.") for i in range(20)]
    rows, want = [], set()
    for d in range(120):
        t = text(rng, rng.choice([30, 200, 1500]))
        if d % 3 == 0:
            i = rng.randrange(20)
            w = items[i][1].replace(".", "").split()
            if d % 2:  # a paraphrase: some words change, some are put in
                for k in rng.sample(range(20), 4):
                    w[k] = "zzz"
                w.insert(5, "moreover")
            at = rng.randrange(len(t.split()))
            t = " ".join([*t.split()[:at], *w, *t.split()[at:]])
            want.add((d, i))
        rows.append((d, t, "en", "s"))
    return items, rows, want


def test_planted_items_are_found(spark, planted):
    items, rows, want = planted
    docs = with_clashes(documents(spark, rows))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 2
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got}


def space_of(texts, bits=12, rank=32):
    """As ``train`` has it, for an array of texts."""
    w = find_words(texts, lower=True)
    df, n = D.passage_frequencies(w, 64, bits)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    g, total = D.gaussian(2**bits, rank + 16, 5), np.zeros((2**bits, rank + 16))
    D.product(w, 64, g * idf[:, None].astype(np.float32), total)
    return (idf[:, None] * D.singular_vectors(total * idf[:, None], g.astype(float), rank)).astype(np.float32)


def test_search_against_brute_force(planted):
    """All passages and all items, by the subsequence or, for paraphrases, cosine and subsequence."""
    items, rows, _ = planted
    texts = pa.array([t for _, t, _, _ in rows])
    it = D.Items(items)
    model = D.Model(it, space_of(texts))
    w = find_words(texts, lower=True)
    h = w.hashes()
    first, owner, start = D.halves_of(w, 64)
    for cosine in (D.COSINE, 0.3):
        got = {(g[0], g[1]): g[5] for g in D.search(model, texts, cosine=cosine)}
        cos = model.places(np.arange(len(owner)), h, owner, start) @ model.q.T
        want = {}
        for d in range(len(texts)):
            for i in range(len(it.ids)):
                n = len(it.words[i])
                for k in range(int(first[d + 1] - first[d])):
                    lo = max(int(w.off[d]), int(w.off[d]) + k * 32 - n)
                    used = it.matched(i, h[lo : min(int(w.off[d + 1]), lo + 64 + 2 * n)].tolist())
                    share, part = used.bit_count() / n, (used >> it.answer_from[i]).bit_count() / (n - it.answer_from[i])
                    if share >= 0.85 or share >= 0.65 and part >= 0.5 or share >= 0.55 and part >= 0.8 and cos[first[d] + k, i] >= cosine:
                        want[d, i] = max(share, want.get((d, i), 0))
        assert got == want and want


def test_paraphrases_are_found_by_the_space():
    """Fewer of the item's words than the subsequence asks for, in passages that stand near it in the space."""
    rng = random.Random(8)
    item = words(rng, 40, vocabulary=3000)
    told = [x if i % 5 in (0, 2, 3) or i > 28 else f"other{i % 5}" for i, x in enumerate(item)]
    others = [" ".join(words(rng, 200, vocabulary=3000)) for _ in range(30)]
    texts = pa.array([" ".join(told), *others, *[" ".join(told[:26] + words(rng, 10)) for _ in range(5)]])
    model = D.Model(D.Items([(1, " ".join(item))]), space_of(texts))
    share = model.items.matched(0, find_words(texts[:1]).hashes().tolist()).bit_count() / 40
    assert 0.55 <= share
    got = D.search(model, texts, lcs=share + 0.01, cosine=0.5)
    assert [g[:2] for g in got] == [(0, 1)] and not D.search(model, texts, lcs=share + 0.01, cosine=1.1)


def test_odd_rows(spark):
    rng = random.Random(4)
    item = " ".join(words(rng, 30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "too short"), (5, "Ωmega"), (1, item)], "item_id long, text string")
    docs = documents(spark, [(1, item, "en", "s"), (1, item, "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, item, "en", "s"), (4, text(rng, 30000) + " " + item, "en", "s"), (5, "... ,", "en", "s"), (6, f"{text(rng, 70)} Too, short! {text(rng, 90)}", "en", "s"), (7, "short too", "en", "s"), (8, "ωmega", "en", "s")])
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in D.contaminated(docs, bench).distinct().collect())
    assert got == [(0, 1), (1, 1), (4, 1), (6, 4), (8, 5)]
    assert sorted(r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()) == [2, 3, 5, 7]
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.drop_contaminated(docs, bench.limit(0)).count() == 10
    named = with_clashes(docs).withColumn("doc_id", docs.doc_id.cast("string"))
    assert {r["item_id"] for r in D.contaminated(named, bench.withColumn("item_id", bench.item_id.cast("string"))).collect()} == {"1", "4", "5"}


def test_verbatim_copies_of_any_length_are_found():
    """A copy of each item among words of the other items, with a space in which the passages don't resemble it."""
    rng = random.Random(6)
    lengths = [15, 16, 18, 20, 24, 28, 33, 40, 50, 59] * 4
    items = [(i, f"{' '.join(words(rng, n - 5, vocabulary=3000))}. {' '.join(words(rng, 5, vocabulary=3000))}.") for i, n in enumerate(lengths)]
    pool = [x for _, t in items for x in t.replace(".", "").split()]
    texts = pa.array([" ".join([*rng.choices(pool, k=rng.randrange(20, 200)), t, *rng.choices(pool, k=150)]) for _, t in items])
    model = D.Model(D.Items(items), D.gaussian(1 << 12, 64, 5))
    got = {g[:2] for g in D.search(model, texts)}
    assert [n for i, n in enumerate(lengths) if (i, i) not in got] == []


def test_chunks_of_items_give_the_same_pairs(spark, planted):
    items, rows, _ = planted
    docs, bench = documents(spark, rows[:60]), spark.createDataFrame(items, "item_id long, text string")
    whole, chunked = ({tuple(r) for r in D.contaminated(docs, bench, chunk=c).select("doc_id", "item_id", "start_word", "end_word", "lcs", F.round("cosine", 4)).collect()} for c in (10**6, 7))
    assert whole and whole == chunked
