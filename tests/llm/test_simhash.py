import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import simhash as S

from .common import documents, text, with_clashes


def test_golay_is_perfect():
    table = S.golay()
    assert (table >= 0).all() and np.bincount(table, minlength=4096).tolist() == [2048] * 4096


def test_segments_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 300)
    y = x.copy()
    for _ in range(2):
        y ^= 1 << rng.integers(0, 23, 300)
    a, b = S.keys_of(x[:, None])[:, 0], S.keys_of(y[:, None])[:, 0]
    for p, q in zip(a, b, strict=True):
        assert set(p[p >= 0]) & set(q[q >= 0])


def near(f, limit):
    n = len(f)
    u = np.asarray(f).view(np.uint64)
    return {(i, i + 1 + int(j)) for i in range(n) for j in np.flatnonzero(S.near(u[i], u[i + 1 :], limit))}


def roots(n, pairs):
    root = list(range(n))
    for x, y in pairs:
        a, b = sorted((root[x], root[y]))
        root = [a if r == b else r for r in root]
    return {i: r for i, r in enumerate(root) if r != i}


def flipped(rng, base, flips):
    p = base.copy()
    for i in range(len(p)):
        for bit in rng.choice(S.BITS, flips, replace=False):
            p[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return p


def prints(n, rng):
    base = rng.integers(0, 1 << 63, (n, 3)).astype(np.uint64)
    base[:, 1] &= np.uint64((1 << 51) - 1)
    return base


@pytest.mark.parametrize("rows", [S.ROWS, 400])  # the second splits every bucket
def test_edges_against_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    base = prints(30, rng)
    f = np.concatenate([base, *[flipped(rng, base, k) for k in range(1, 15)]]).view(np.int64)
    reps = spark.createDataFrame([(i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(f)], "node long, f1 long, f2 long, f3 long")
    edges = S.near_edges(reps, rows=rows)
    got = roots(len(f), [(r["a"], r["b"]) for r in edges.collect()])
    sure, want = roots(len(f), near(f, 8)), roots(len(f), near(f, S.LIMIT))
    assert sure.keys() <= got.keys() and all(got[i] <= r for i, r in sure.items())  # certain
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.9 * len(want)


def test_the_words_order_verifies():
    """Fingerprints of the same bits, of which the third part, voted by neighbouring words, is far."""
    rng = random.Random(5)
    w = text(rng, 60).split()
    f, _ = S.fingerprint_batch(pa.array(["dog bites man today", "man bites dog today", " ".join(w), " ".join(rng.sample(w, 60)), " ".join([*w[:30], "put", *w[30:]])]))
    assert (f[0, :2] == f[1, :2]).all() and not S.near(f[0], f[1:2])[0]
    assert (f[2, :2] == f[3, :2]).all() and S.near(f[2], f[3:]).tolist() == [False, True]


@pytest.mark.parametrize("small", [S.SMALL, 1])  # groups of any size by growing the forest
def test_hanging_together_against_all_pairs(small):
    rng = np.random.default_rng(4)
    base = prints(4, rng)
    f = np.concatenate([flipped(rng, base, k) for k in [5, 6, 7, 8, 9, 10] * 8])
    key = rng.integers(0, 3, len(f)).astype(np.uint32)
    got, label = S.hang_together(key, f, small=small)
    place = {tuple(p): i for i, p in enumerate(f.tolist())}
    found = roots(len(f), [tuple(sorted((place[tuple(got[i].tolist())], place[tuple(got[j].tolist())]))) for i, j in enumerate(label)])
    assert found == roots(len(f), [(x, y) for x, y in near(f, S.LIMIT) if key[x] == key[y]])


def test_a_family_of_one_template():
    """Thousands that share keys: the edges passed on are one each, whatever the number of near pairs."""
    rng = np.random.default_rng(5)
    base = prints(1, rng)
    f = np.unique(np.concatenate([flipped(rng, base, k % 6) for k in range(6000)]), axis=0)
    row, key = S.pair_keys(f.view(np.int64))
    got, label = S.hang_together(key, f[row])
    assert len(got) == len(f) and (label == label[0]).all()


def test_components(spark):
    pairs = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 5), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in S.components(pairs).collect() if r["node"] != r["root"]} == {5: 2, 4: 2, 3: 2, 9: 8}
    assert S.components(pairs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for g in range(12):
        t = text(rng, 200)
        out.append((g * 10, t, "en", "s"))
        for c in range(1, 4):
            w = t.split()
            for _ in range(c):
                w[rng.randrange(len(w))] = "changed"
            out.append((g * 10 + c, " ".join(w), "en", "s"))
    return [*out, (900, None, "en", "s"), (901, "", "en", "s"), (902, "", "en", "s"), (903, "... !", "en", "s"), (None, "null id", "en", "s"), (None, "null id", "en", "s"), (0, out[0][1], "en", "s"), (905, "word " * 60000, "en", "s"), (906, "one", "en", "s"), (907, "one", "en", "s")]


def test_groups_and_odd_rows(spark, rows):
    docs = with_clashes(documents(spark, rows))
    got = {r["doc_id"]: r["kept_doc_id"] for r in S.near_duplicates(docs).collect()}
    assert got == {g * 10 + c: g * 10 for g in range(12) for c in range(1, 4)} | {907: 906}
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.select("doc_id").collect()) == sorted([g * 10 for g in range(12)] + [900, 901, 902, 903, -1, -1, 905, 906])


def test_groups_against_brute_force(spark, rows):
    texts = [(i, t) for i, t, _, _ in rows if i is not None and t and i < 900]
    f, _ = S.fingerprint_batch(pa.array([t for _, t in texts]))
    want = {texts[i][0]: texts[r][0] for i, r in roots(len(f), near(f, S.LIMIT)).items() if texts[i][0] != texts[r][0]}
    got = {r["doc_id"]: r["kept_doc_id"] for r in S.near_duplicates(documents(spark, [r for r in rows if r[0] is not None and r[0] < 900])).collect()}
    assert len(set(got.items()) & set(want.items())) >= 0.9 * len(want)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rng = random.Random(6)
    a, b, c = text(rng, 80), text(rng, 80), text(rng, 80)
    docs = documents(spark, [(1, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (5, b, "en", "t"), (7, b + " x", "en", "s"), (3, c, "en", "s"), (3, c + " y", "en", "s"), (None, a, "en", "s")])
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in S.drop_near_duplicates(docs).collect())
    assert (1, a) in kept and (5, b) in kept and (0, a) in kept and len(kept) == 4 and len([k for k in kept if k[0] == 3]) == 1
    got = {r["doc_id"]: r for r in S.near_duplicates(docs).collect()}
    assert got.keys() == {5, 7} and got[5]["kept_doc_id"] == 1 and (got[5]["n_links"], got[5]["n_copies"]) == (0, 1) and got[7]["kept_doc_id"] == 5 and got[7]["n_links"] == 1


def test_ids_of_another_type_and_columns_of_any_name(spark):
    rng = random.Random(7)
    t = text(rng, 60)
    docs = spark.createDataFrame([("b", t, "1"), ("a", t, "2"), ("c", text(rng, 60), "3")], "doc_id string, text string, n string")
    names = ["__h", "__n", "__gone_id", "__gone_h", "h", "f1", "f3", "node", "root", "kept_doc_id", "least", "u", "m", "unit", "__N_"]
    docs = docs.select("*", *[F.lit("x").alias(x) for x in names])
    out = S.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == ["a", "c"] and out.filter("__h = 'x' and __n = 'x'").count() == 2


def test_empty_table(spark):
    docs = documents(spark, [])
    assert S.near_duplicates(docs).count() == 0 and S.drop_near_duplicates(docs).count() == 0
