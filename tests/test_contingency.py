import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.corpus import Corpus, score_text
from lexweave.operators.contingency import Contingency
from lexweave.operators.kernel import Counter

from . import brute

NARRATIVE = "a a b"


def kernel(docs, nodes, window, minfreq=1, per_doc=False):
    batch = pa.RecordBatch.from_pydict({"__text": pa.array([" ".join(d) if d is not None else None for d in docs], pa.string())})
    out = {}
    for b in Counter(nodes, window, minfreq, [], per_doc)([batch]):
        for r in b.to_pylist():
            out[r["Node"], r["Collocate"]] = (r["a"], r["b"], r["c"], r["d"], r["DocFrequency"])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), min_size=1, max_size=4), st.sampled_from(["a", "a b", "a a", "a b c"]), st.integers(1, 6))
def test_kernel_is_brute_force(docs, node, window):
    got = {w: v for (_, w), v in kernel(docs, [node], window).items()}
    assert got == brute.corpus(docs, node, window, 1)


def test_negative_d_is_kept():
    docs = [list("bab") + list("b" * 9) + list("cc")]
    assert kernel(docs, ["a"], 1)["a", "b"] == (2, 0, 9, 2 - 9, 1)


def test_nulls_and_empty_texts_count_nothing():
    assert kernel([None, [], ["a"]], ["a"], 2) == {}


@pytest.mark.parametrize(("text", "node", "window", "want"), [
    ("a b a c a b a b c", "a", 2, {"a": (4, 0, 0, 0), "b": (3, 0, 0, 0), "c": (2, 1, 0, 0)}),
    ("machine learning is great and machine learning works", "machine learning", 2, {"and": (1, 1, 0, 0), "great": (1, 0, 0, 0), "is": (1, 1, 0, 0), "works": (1, 1, 0, 0)}),
    ("big data and data science require data analysis", "data", 2, {"analysis": (1, 2, 0, 0), "and": (1, 1, 0, 0), "big": (1, 2, 0, 0), "data": (2, 1, 0, 0), "require": (1, 1, 0, 0), "science": (1, 1, 0, 0)}),
])
def test_worked_examples(spark, text, node, window, want):
    rows = Corpus.from_text(spark, text).document_contingency(node, window, 1).df.collect()
    assert {r["Collocate"]: (r["a"], r["b"], r["c"], r["d"]) for r in rows} == want


def test_corpus_groups_and_sums(spark):
    rng = random.Random(4)
    docs = [[rng.choice("abcde") for _ in range(rng.randint(0, 60))] for _ in range(20)]
    rows = [(i, " ".join(d), "xy"[i % 2], None) for i, d in enumerate(docs)] + [(99, None, "x", None)]
    corpus = Corpus(spark.createDataFrame(rows, "doc_id long, text string, g string, a string"))
    whole = corpus.contingency(["a", "b c"], 3, 2)
    got = {(r["Node"], r["Collocate"]): (r["a"], r["b"], r["c"], r["d"], r["DocFrequency"]) for r in whole.df.collect()}
    assert got == {(n, w): v for n in ("a", "b c") for w, v in brute.corpus(docs, n, 3, 2).items()}
    by = corpus.contingency(["a"], 3, 1, by=["g"]).df.collect()
    for g in (0, 1):
        assert {r["Collocate"]: r["a"] for r in by if r["g"] == "xy"[g]} == {w: v[0] for w, v in brute.corpus(docs[g::2], "a", 3, 1).items()}


def test_margins_and_expected_counts(spark):
    t = Contingency.from_df(spark.createDataFrame([("x", 5, 2, 1, 10), ("y", 3, 4, 2, 8)], "Collocate string, a long, b long, c long, d long"), "n", 5, 1)
    r = t.df.filter("Collocate = 'x'").first()
    assert (r["m"], r["n"], r["k"], r["l"], r["Total"]) == (7, 11, 6, 12, 18)
    assert r["E11"] == pytest.approx(7 * 6 / 18)
    assert t.score("Dice").count() == 2


def test_bad_arguments(spark):
    c = Corpus.from_text(spark, "a b c")
    for bad in (lambda: c.contingency("a", 0, 1), lambda: c.contingency("a", 5, 0), lambda: c.contingency(" ", 5, 1), lambda: c.contingency("a", 5, 1).score("Nothing"), lambda: c.contingency("a", 5, 1).score([])):
        with pytest.raises(ValueError):
            bad()


def test_no_data_is_an_empty_table(spark):
    empty = Corpus(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.contingency("a", 5, 1).score(["PMI", "LexicalGravity"]).count() == 0
    assert score_text(spark, "PMI", "word " * 10, "word", 5, 100).df.count() == 0
    assert score_text(spark, "PMI", "a b c", "missing", 5, 1).df.count() == 0


def test_node_and_text_share_the_normalisation(spark):
    c = Corpus.from_texts(spark, ["Café—NAÏVE, café!! résumé"])
    assert {r["Collocate"] for r in c.contingency("CAFÉ", 2, 1).df.collect()} == {"naïve", "café", "résumé"}
    assert c.node_present("Naïve") and not c.node_present("cafe")


def test_a_worker_counts_a_megabyte_at_a_time():
    import pyarrow as pa

    from lexweave.operators.kernel import batches_of

    text = pa.array(["a " * 1000] * 5000 + ["b " * 2_000_000, None, ""])
    got = list(batches_of([pa.RecordBatch.from_arrays([text], ["__text"])], "__text"))
    assert pa.concat_arrays([b.column(0) for b in got]).equals(text)
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(0).to_pylist()) <= 1 << 20 for b in got)
