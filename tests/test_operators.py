import math

import pytest
from pyspark.sql import functions as F

from lexweave.corpus import Corpus
from lexweave.operators import compare, keywords, kwic, network, recipes, stats, subcorpus, temporal
from lexweave.result import Result, combine_results, filter_scores

TEXTS = ["innovation drives growth", "innovation needs research", "research drives innovation", "business likes innovation", "growth needs business", "innovation and growth"]


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.from_texts(spark, TEXTS, metadata={"year": [2020, 2020, 2021, 2021, 2022, 2022], "field": ["tech", "tech", "res", "res", "biz", None]})


@pytest.fixture(scope="module")
def empty(spark):
    return Corpus(spark.createDataFrame([], "doc_id long, text string, year int, field string"))


def test_stats(spark):
    c = Corpus.from_texts(spark, ["word1 word2 word3 word4", "word1 word5 word6 word7", "word1 word8 word9 Word9"])
    r = stats.corpus_stats(c).first()
    assert (r["num_documents"], r["total_tokens"], r["vocabulary_size"], r["hapax_count"], r["max_type_frequency"]) == (3, 12, 9, 7, 3)
    assert r["words_for_25"] == 1 and r["words_for_100"] == 9 and r["type_token_ratio"] == pytest.approx(0.75)
    cover = stats.vocab_coverage(c, [0.25, 0.5, 0.75, 1.0]).orderBy("Percentile").collect()
    assert [x["WordsNeeded"] for x in cover] == [1, 3, 6, 9]
    d = {x["Token"]: x for x in stats.token_distribution(c).collect()}
    assert d["word1"]["IDF"] == 0 and d["word9"]["DocFrequency"] == 1 and d["word9"]["TFIDF"] == pytest.approx(2 * math.log(3))
    assert "types: 9" in stats.coverage_summary(stats.corpus_stats(c))


def test_empty_corpus(empty):
    assert stats.corpus_stats(empty).first()["total_tokens"] == 0
    assert stats.token_distribution(empty).count() == 0
    for m in keywords.METHODS:
        assert keywords.keyterms(empty, m).count() == 0
    assert kwic.kwic(empty, "x").lines.count() == 0
    with pytest.raises(ValueError):
        temporal.analyze_temporal(empty, ["x"], "year")
    assert network.colloc_graph(empty, ["x"], depth=2).edges.count() == 0


def test_keywords(corpus):
    rows = keywords.keyterms(corpus, "tfidf", 50, 1, 1.0).collect()
    got = {r["Keyword"]: r["TFIDF"] for r in rows}
    assert got["needs"] == pytest.approx(2 / 6 * math.log(6 / 2)) and len(got) == 8
    assert "and" not in {r["Keyword"] for r in keywords.keyterms(corpus, "tfidf", 50, 1, 1.0, "en").collect()}
    rake = {r["Keyword"]: r for r in keywords.keyterms(corpus, "rake", None, stop=["and", "needs"]).collect()}
    assert rake["growth"]["Frequency"] == 2 and rake["innovation drives growth"]["WordCount"] == 3
    with pytest.raises(ValueError):
        keywords.keyterms(corpus, "other")


def test_rake_is_its_definition(spark):
    texts = ["aa the bb cc bb the aa", "cc dd the x the cc dd", "The aa", "", None, "the x"]
    df = keywords.rake(Corpus.from_texts(spark, texts), None, stop=["the"])
    found = [[p.strip() for p in " ".join("/" if w == "the" or len(w) < 2 else w for w in (t or "").lower().split()).split("/") if p.strip()] for t in texts]
    every = [p for doc in found for p in doc]
    mean = {w: sum(len(p.split()) * p.split().count(w) for p in every) / sum(p.split().count(w) for p in every) for p in every for w in p.split()}
    want = {p: (pytest.approx(sum(mean[w] for w in p.split())), every.count(p), len(p.split()), sum(p in doc for doc in found)) for p in every}
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == want
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()  # no phrase travels with each of its words


def test_textrank_is_power_iteration(corpus):
    import numpy as np

    rows = keywords.textrank(corpus, None).collect()
    words = sorted({w for t in TEXTS for w in t.split()})
    m = np.zeros((len(words), len(words)))
    for t in TEXTS:
        w = [words.index(x) for x in t.split()]
        for i in range(len(w)):
            for j in range(len(w)):
                if i != j and abs(i - j) <= 5:
                    m[w[i], w[j]] += 1
                    m[w[j], w[i]] += 1
    m /= m.sum(axis=1, keepdims=True)
    s = np.full(len(words), 1 / len(words))
    for _ in range(100):
        new = 0.15 / len(words) + 0.85 * (m.T @ s)
        done = abs(new - s).max() < 1e-4
        s = new
        if done:
            break
        s = s / s.sum()
    assert {r["Keyword"]: r["TextRankScore"] for r in rows} == pytest.approx(dict(zip(words, s, strict=True)))


def test_pairs_of_a_word_with_itself(spark):
    got = {(r["x"], r["y"]): r["n"] for r in keywords.word_pairs(Corpus.from_text(spark, "a a b")).collect()}
    assert got == {("a", "a"): 4, ("a", "b"): 4, ("b", "a"): 4}


def test_pairs_travel_in_blocks(spark):
    texts = ["a the b c a d e f g a", "The b b a", "", None, "x"]
    df = keywords.word_pairs(Corpus.from_texts(spark, texts), 3, stop=["the"])
    want = {}
    for t in texts:
        w = [x for x in (t or "").lower().split() if x != "the"]
        for i in range(len(w)):
            for j in range(max(0, i - 3), min(len(w), i + 4)):
                if i != j:
                    want[w[i], w[j]] = want.get((w[i], w[j]), 0) + 2
    assert {(r["x"], r["y"]): r["n"] for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan  # no row a pair before the pairs are summed


def test_kwic(spark):
    c = Corpus.from_texts(spark, ["a b a b c", "b a b"])
    k = kwic.kwic(c, "A b", 1, 2)
    assert [tuple(r) for r in k.lines.collect()] == [("", "a b", "a", 1, 1), ("b", "a b", "c", 1, 3)]
    s = k.statistics.first()
    assert (s["total_occurrences"], s["documents_with_node"], s["lines_generated"], s["truncated"], s["ngram_length"]) == (3, 2, 2, True, 2)


def test_temporal(corpus, spark):
    t = temporal.analyze_temporal(corpus, ["Innovation"], "year", "LogDice", 2, 5, 1)
    assert [r["PeriodLabel"] for r in t.periods.orderBy("Period").collect()] == ["2020-2021", "2021-2022"]
    trend = {r["Collocate"]: r for r in t.trends.collect()}
    assert trend["growth"]["NumPeriods"] == 2 and min(abs(abs(trend["growth"]["Correlation"]) - x) for x in (0, 1)) < 1e-9
    shift = temporal.semantic_shift(t, 1, 2).first()
    assert 0 <= shift["Shift"] <= 1 and shift["Kept"] + shift["Lost"] + shift["Gained"] > 0
    assert temporal.compare_periods(t, 1, 2).count() == shift["Kept"]
    assert temporal.time_series(t, "innovation", "growth").count() == 2
    assert temporal.bursts(t, 0).count() == 0 and temporal.emerging(t.trends).count() + temporal.declining(t.trends).count() >= 0
    dates = spark.createDataFrame([("2020-12-31",), ("31/12/2019",), ("2018",), ("x",), (None,)], "d string")
    assert [r[0] for r in dates.select(temporal.parse_time(F.col("d"))).collect()] == [2020, 2019, 2018, None, None]
    with pytest.raises(ValueError):
        temporal.analyze_temporal(corpus, ["x"], "nothing")


def test_subcorpora(corpus):
    s = subcorpus.compare_subcorpora(corpus, "field", "innovation", "Dice", 5, 1)
    summary = {r["Subcorpus"]: r["NumCollocates"] for r in s.summary.collect()}
    assert summary == {"tech": 4, "res": 4, "biz": 0}
    both = s.effects.collect()
    assert {r["Collocate"] for r in both} == {"drives", "research"} and all(r["Group1"] < r["Group2"] and r["CohensD"] is None for r in both)
    assert subcorpus.effect_sizes(s.scores, "Dice", compat=True).first()["EffectSize"] == "Small"
    assert s.parameters.count() == 5


def test_compare(spark):
    rows = [(f"w{i}", i, float(i), float(-i), float(i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "Collocate string, Frequency long, x double, y double, z double")
    corr = {(r[0], r[1]): r[2] for r in compare.spearman(df, ["x", "y", "z"]).collect()}
    assert corr["x", "x"] == pytest.approx(1) and corr["x", "y"] == pytest.approx(-1)
    tau = {(r[0], r[1]): r[2] for r in compare.kendall(df, ["x", "y"]).collect()}
    assert tau["x", "y"] == pytest.approx(-1)
    got = compare.compare_metrics(df, ["x", "y", "z"], ks=[10])
    assert {r["Pair"]: r["Overlap"] for r in got.topk_overlap.collect()}["x-y"] == 0
    assert got.by_band_corr.count() == 9 and got.rank_diffs.count() == 30
    same = compare.compare_metrics(df.withColumn("x2", F.col("x") * 2), ["x", "x2"])
    assert same.metadata["early_exit"] and same.topk_overlap is None
    assert compare.stratified_sample(df, 0.01).count() == 3


def test_network(corpus):
    g = network.colloc_graph(corpus, ["Innovation"], "LogDice", depth=2, max_neighbors=3, minfreq=1, compute_centrality=True, centrality_metrics=network.CENTRALITIES, weight_normalization="minmax")
    layer = {r["Node"]: r["Layer"] for r in g.node_metrics.collect()}
    assert layer["innovation"] == 0 and set(layer) == set(g.nodes)
    assert sum(r["Centrality_pagerank"] for r in g.node_metrics.collect()) == pytest.approx(1, abs=1e-3)
    assert all(0.0 <= r["NormalizedWeight"] <= 1.0 for r in g.edges.collect())
    u = network.colloc_graph(corpus, ["innovation"], "LogDice", 1, max_neighbors=2, minfreq=1, direction="undirected", weight_normalization="rank", compute_centrality=True, centrality_metrics=["closeness", "nonsense"])
    for r in u.node_metrics.collect():
        assert r["InDegree"] == r["OutDegree"] == r["TotalDegree"] and r["Centrality_nonsense"] == 0
    assert all(r["Source"] <= r["Target"] for r in u.edges.collect())
    for bad in ({"depth": 0}, {"direction": "in"}, {"weight_normalization": "x"}, {"undirected_weight_stat": "x"}, {"max_neighbors": -1}):
        with pytest.raises(ValueError):
            network.colloc_graph(corpus, ["innovation"], **bad)


def test_rounding_does_not_rank_neighbours(spark):
    times = {"j": 1, "i": 2, "h": 4, "g": 8, "f": 3, "e": 5, "d": 6, "c": 7, "b": 9, "a": 11}  # all score 14, but for the last bits of log2
    c = Corpus.from_texts(spark, [f"x {w}" for w, n in times.items() for _ in range(n)])
    for n in (1, 3, 5):
        g = network.colloc_graph(c, ["x"], "LogDice", 1, max_neighbors=n, minfreq=1)
        assert sorted(r["Target"] for r in g.edges.collect()) == sorted(times)[:n]


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "Source string, Target string")
    got = {r["Node"]: r for r in network.centralities(edges, ["a", "b", "c"], ["betweenness", "harmonic"], "undirected").collect()}
    assert got["b"]["Centrality_betweenness"] == pytest.approx(1) and got["a"]["Centrality_harmonic"] == pytest.approx(0.75)


def test_recipes(corpus):
    s = corpus.contingency("innovation", 5, 1).score(["Dice", "LLR", "ChiSquare", "Tscore", "Zscore"])
    assert recipes.significance(s).filter("Significant").count() == 0
    c = recipes.composite(s, {"Dice": 0.5, "LLR": 0.5}).agg(F.max("Composite"), F.min("Composite")).first()
    assert 0 <= c[1] <= c[0] <= 1
    assert recipes.window_comparison(corpus, "innovation", "Dice", [1, 2], 1).select("WindowSize").distinct().count() == 2
    assert recipes.shared_contexts(corpus, ["innovation", "growth"], "Dice", 5, 1).first()["Shared"] > 0
    assert recipes.features(corpus, ["innovation"], "Dice", 5, 1, 2).first()["Features"].keys()
    assert [r[0] for r in s.limit(1).select(recipes.stars(F.lit(7.0))).collect()] == ["**"]
    assert recipes.bonferroni(s.withColumn("p", F.lit(0.001)), "p").first()["Significant"]
    assert recipes.filter_vocabulary(corpus, 2).count() == 6


def test_results(corpus):
    r = corpus.analyze_node("Innovation", ["LogDice", "Dice"], 5, 1, 3)
    rows = r.df.collect()
    assert len(rows) == 3 and rows[0]["LogDice"] >= rows[-1]["LogDice"] and "DocFrequency" in r.df.columns
    assert r.summary() == "Analysis of 'innovation' using LogDice, Dice (window=5, minfreq=1)"
    assert filter_scores(r, 1e9).df.count() == 0
    both = combine_results([r, Result(r.df.drop("Dice"), {"node": "other", "metric": "LogDice"})])
    assert both.df.count() == 6 and both.meta["n_sources"] == 2 and both.meta["combined_nodes"] == ["innovation", "other"]
    many = corpus.analyze_nodes(["innovation", "growth"], "Dice", 5, 1, 2).df
    assert {x["Node"]: x["count"] for x in many.groupBy("Node").count().collect()} == {"innovation": 2, "growth": 2}
