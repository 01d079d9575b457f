import pytest
from pyspark.sql import functions as F

from lexweave.corpus import Corpus
from lexweave.functions import text as T
from lexweave.functions.text import TextNorm


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("norm", "text", "want"), [
    (TextNorm(), "This is a test.   This is—only a TEST!", "this is a test this is only a test "),
    (TextNorm(strip_accents=True), "Café—NAÏVE, résumé\n", "cafe naive resume "),
    (TextNorm(punctuation_to_space=False), "don't e-mail", "dont email"),
    (TextNorm(normalize_whitespace=False, strip_whitespace=True), "a b\tc", "abc"),
    (TextNorm(strip_case=False, strip_punctuation=False, unicode_form=None), "A, b", "A, b"),
    (TextNorm(), "$5 + a|b = <c>", "$5 + a|b = <c>"),
    (TextNorm(unicode_form="NFD"), "é", "é"),
    (TextNorm(), "é", "é"),
    (TextNorm(), None, None),
])
def test_normalised(spark, norm, text, want):
    assert one(spark, text, T.normalised(F.col("t"), norm)) == want


def test_greek(spark):
    got = one(spark, "Το ελληνικό κείμενο με τόνους", T.normalised(F.col("t"), TextNorm(strip_accents=True)))
    assert got == "το ελληνικο κειμενο με τονους"
    assert T.strip_diacritics("café") == "cafe"


def test_nodes():
    assert T.normalize_node("  Machine   Learning ", TextNorm()) == "machine learning"
    assert T.normalize_node("e-mail", TextNorm()) == "e-mail"
    assert T.ngram_length("a b c") == 3 and T.is_single_word("a")
    with pytest.raises(ValueError):
        TextNorm(unicode_form="XYZ")
    with pytest.raises(ValueError):
        TextNorm.from_dict({"nope": 1})
    assert TextNorm.from_dict({"strip_case": False}).strip_case is False


def test_positions_and_contexts(spark):
    toks = F.split("t", " ")
    assert one(spark, "a a b a a", T.ngram_positions(toks, "a a")) == [0, 3]
    assert one(spark, "a", T.ngram_positions(toks, "a a")) == []
    ctx = one(spark, "x a b y z", T.ngram_contexts(toks, "a b", 2))
    assert [(c["position"], c["left"], c["right"]) for c in ctx] == [(1, ["x"], ["y", "z"])]


def test_fox(spark):
    text, toks = "the quick brown fox jumps over the lazy dog", F.split("t", " ")
    assert one(spark, text, T.prior_words(toks, "fox", 2)) == ["brown", "quick"]
    assert one(spark, text, T.following_words(toks, "fox", 2)) == ["jumps", "over"]
    assert one(spark, text, T.count_word(toks, "the")) == 2
    assert one(spark, "a.b.c a+b", T.count_substrings(F.col("t"), ["a.", "+"])) == 2


def test_stopwords():
    assert "the" in T.stopwords("en") and "και" in T.stopwords("greek") and T.stopwords("nowhere") == []
    assert T.stopword_support(["en", "xx"])["xx"] == 0


def test_raw_tokens(spark):
    c = Corpus(spark.createDataFrame([(1, "Don't stop, now_1!")], "doc_id long, text string"), preprocess=False)
    assert c.with_tokens().first()["tokens"] == ["Don", "'", "t", "stop", ",", "now_1", "!"]


def test_corpus_basics(spark):
    c = Corpus.from_texts(spark, ["b a b", "c a", None, ""])
    assert [(r["token"], r["idx"]) for r in c.vocabulary().orderBy("idx").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    assert {(r["doc_id"], r["token"]): r["tf"] for r in c.document_term_matrix().collect()} == {(1, "b"): 2, (1, "a"): 1, (2, "c"): 1, (2, "a"): 1}
    assert c.filter_length(2, 2).df.count() == 1
    assert c.renormalize(TextNorm(strip_case=False), 3).df.count() == 1
    with pytest.raises(ValueError):
        Corpus.from_df(c.df, "nothing")
