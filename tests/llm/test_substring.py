import random

import pytest

from lexweave.llm import substring as S

from .common import documents, text, with_clashes


def brute(docs, block, min_words):
    """Stretches (doc, start, end) by comparing all windows with the earliest reference block of the same words."""
    first = {}
    for d, t in sorted(docs):
        w = t.split()
        for p in range(0, len(w) - block + 1, block):
            first.setdefault(tuple(w[p : p + block]), (d, p))
    out, texts = set(), {d: t.split() for d, t in docs}
    for d, w in texts.items():
        cover = []
        for p in range(len(w) - block + 1):
            hit = first.get(tuple(w[p : p + block]))
            if hit is None or not (hit[0] < d or hit[0] == d and hit[1] + block <= p):
                continue
            r, q = texts[hit[0]], hit[1]
            s, e, k = p, p + block, 0
            while k < block - 1 and s > 0 and q > 0 and w[s - 1] == r[q - 1]:
                s, q, k = s - 1, q - 1, k + 1
            shift = s - q
            while e < len(w) and e - shift < len(r) and w[e] == r[e - shift] and (hit[0] != d or e - shift < s):
                e += 1
            cover.append((s, e))
        cover.sort()
        merged = []
        for s, e in cover:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(d, s, e) for s, e in merged if e - s >= min_words}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stretches_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [text(rng, rng.randint(8, 30)) for _ in range(6)]
    docs = []
    for d in range(30):
        parts = [rng.choice([text(rng, rng.randint(3, 20)), rng.choice(passages)]) for _ in range(5)]
        docs.append((d, " ".join(parts)))
    got = {(r["doc_id"], r["stretch_start"], r["stretch_end"]) for r in S.repeats(documents(spark, [(d, t, "en", "s") for d, t in docs]), 4, 8, 3).collect()}
    want = brute(docs, 4, 8)
    assert got == want and got and all(e - s >= 8 for _, s, e in got)


def test_repeats_are_exact_and_maximal(spark):
    rng = random.Random(7)
    shared = text(rng, 80)
    docs = [(1, f"{text(rng, 20)} alpha {shared} omega {text(rng, 10)}"), (2, f"{text(rng, 33)} beta {shared} gamma"), (3, f"{shared} {shared}")]
    rows = S.repeats(documents(spark, [(d, t, "en", "s") for d, t in docs])).collect()
    by = dict(docs)
    for r in rows:
        w, ref = by[r["doc_id"]].split(), by[r["ref_doc_id"]].split()
        assert w[r["start_word"] : r["end_word"]] == ref[r["ref_start_word"] : r["ref_start_word"] + r["n_words"]]
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in rows} >= {(2, 34, 114), (3, 0, 80)}
    assert {r["doc_id"] for r in rows} == {2, 3}


def test_a_repeat_goes_on_over_blocks_whose_anchors_are_elsewhere(spark):
    """Inner blocks of the passage have their anchors in an earlier document, and so have those of a long tail."""
    rng = random.Random(9)
    p = text(rng, 1400).split()
    docs = [(0, " ".join(p[75:125])), (3, " ".join(p[200:])), (5, " ".join(p)), (10, f"x y z {' '.join(p)} q")]
    rows = S.repeats(documents(spark, [(d, t, "en", "s") for d, t in docs])).collect()
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in rows if r["ref_doc_id"] == 5}
    assert got == {(10, 3, 1403)}


def test_contents_of_equal_low_bits_keep_an_anchor_each(monkeypatch, spark):
    rng = random.Random(12)
    a, b = text(rng, 60), text(rng, 60)
    monkeypatch.setattr(S, "LOW40", S.np.uint64(0xFF))  # nearly all collide, in the driver's process
    texts = S.pa.array([a, b, f"x {b} {a}"])
    batch = S.pa.RecordBatch.from_arrays([S.pa.array([1, 2, 3]), texts], ["doc_id", "text"])
    rows = sorted((r for o in S._emit(1, 25)(iter([batch])) for r in o.to_pylist()), key=lambda r: r["kind"])
    cols = S._packed([(r["bucket"], r["kind"], r["docs"], r["packed"], r["around"]) for r in rows])
    hits = {(h["doc"], h["pos"], h["ref"], h["rpos"]) for o in S._probe(25)(iter([cols])) for h in o.to_pylist()}
    assert {(3, 1, 2, 0), (3, 61, 1, 0), (3, 86, 1, 25)} <= hits


def test_cutting(spark):
    rng = random.Random(8)
    shared, tail = text(rng, 60), text(rng, 30)
    docs = with_clashes(documents(spark, [(1, shared, "en", "s"), (2, f"start {shared} {tail}", "en", "s"), (3, shared, "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"), (None, shared, "en", "s"), (6, text(rng, 49), "en", "s"), (7, tail, None, None), (7, tail, None, None), (8, "other text", "en", "s"), (8, shared, "en", "s")]))
    out = S.cut_repeats(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()), key=str)
    by = {}
    for d, t, _ in got:
        by.setdefault(d, []).append(t)
    assert by[1] == [shared] and by[2] == [f"start {tail}"] and 3 not in by and by[4] == [None] and by[5] == [""] and by[0] == [shared]
    assert by[7] == [tail, tail] and sorted(by[8]) == sorted(["other text", shared])  # the first text of doc 8 is the document
    assert all(n == len(t) for _, t, n in got if t is not None)
    named = docs.withColumns({n: S.F.lit("x") for n in ("__id", "__cut", "__first", "__of", "__CUT_")})
    assert S.cut_repeats(named).columns == named.columns and S.cut_repeats(named).count() == len(got)


def test_empty_and_long(spark):
    assert S.repeats(documents(spark, [])).count() == 0 and S.cut_repeats(documents(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(60000))
    got = S.repeats(documents(spark, [(1, long, "en", "s"), (2, long, "en", "s")])).collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in got] == [(2, 0, 60000)]


def test_passages_around_boilerplate_are_found(spark):
    """Every window of min_words that stood before is covered, though its blocks also stand in earlier documents that go on otherwise."""
    rng = random.Random(11)
    docs = []
    for case in range(25):
        s = text(rng, 40)
        passage = f"{text(rng, 10)} {s} {text(rng, 10)}"
        docs += [f"{text(rng, 25)} {s} {text(rng, 30)}", f"{text(rng, case + 1)} {passage} {text(rng, 20)}", f"{text(rng, 13)} {passage} {text(rng, 9)}"]
    words = [d.split() for d in docs]
    first, want = {}, set()
    for d, w in enumerate(words):
        for p in range(len(w) - 49):
            if first.setdefault(tuple(w[p : p + 50]), d) < d:
                want |= {(d, i) for i in range(p, p + 50)}
    rows = S.repeats(documents(spark, [(d, t, "en", "s") for d, t in enumerate(docs)])).collect()
    assert len(want) == 25 * 60 and want <= {(r["doc_id"], i) for r in rows for i in range(r["stretch_start"], r["stretch_end"])}
    for r in rows:
        ref = words[r["ref_doc_id"]][r["ref_start_word"] :][: r["n_words"]]
        assert words[r["doc_id"]][r["start_word"] : r["end_word"]] == ref
