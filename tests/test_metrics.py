import math

import numpy as np
import pytest

from lexweave.functions.metrics import EPS, METRICS, Cells, available_metrics, bllr_with, bpmi_with, g2, register_metric
from lexweave.functions.special import fisher_right_values
from lexweave.operators.contingency import Contingency

ROWS = [("p", 5, 2, 1, 10), ("q", 3, 4, 2, 8), ("zero_b", 4, 0, 3, 20), ("zero_c", 4, 2, 0, 20), ("negative", 6, 1, 9, -4), ("only_a", 3, 0, 0, 0)]


@pytest.fixture(scope="module")
def table(spark):
    return Contingency.from_df(spark.createDataFrame(ROWS, "Collocate string, a long, b long, c long, d long"), "n", 5, 1)


@pytest.fixture(scope="module")
def scores(table):
    names = [m for m in available_metrics() if not METRICS[m].needs_tokens]
    return {r["Collocate"]: r.asDict() for r in table.score(names).collect()}


def test_there_are_52():
    assert len([m for m in METRICS.values() if m.family != "custom"]) == 52


@pytest.mark.parametrize("group", [("Dice", "CzekanowskiDiceCoef"), ("JaccardIdx", "GowerCoef", "TanimotoCoef"), ("OchiaiIdx", "CosineSim"), ("RogersTanimotoCoef", "SokalSneathIdx", "MountfordCoef"), ("RogersTanimotoCoef2", "GowerCoef2"), ("YuleQ", "GoodmanKruskalIdx"), ("RiskDiff", "AttrRisk", "DeltaPiRight"), ("CramersV", "TschuprowT")])
def test_equal_measures(scores, group):
    for r in scores.values():
        assert len({round(r[m], 9) for m in group}) == 1


def test_closed_forms(scores):
    a, b, c, d = 5.0, 2.0, 1.0, 10.0
    m, n, k, l, t = 7, 11, 6, 12, 18
    e = [m * k / t, m * l / t, n * k / t, n * l / t]
    r = scores["p"]
    want = {
        "PMI": math.log(a / (k * m)), "PMI2": 2 * math.log(a) - math.log(k * m), "LLR": 2 * sum(o * math.log(o / x) for o, x in zip((a, b, c, d), e, strict=True)),
        "ChiSquare": sum((o - x) ** 2 / x for o, x in zip((a, b, c, d), e, strict=True)), "Tscore": (a - e[0]) / math.sqrt(a), "OddsRatio": a * d / (b * c), "LogDice": 14 + math.log2(2 * a / (m + k)),
        "MinSens": min(a / m, d / n), "PhiCoef": (a * d - b * c) / math.sqrt(m * n * k * l), "RelRisk": a * n / (c * m), "DeltaPiLeft": a / k - b / l, "KulczynskiSim": (a / m + a / k) / 2,
        "FisherRight": sum(math.comb(k, x) * math.comb(t - k, m - x) for x in range(5, 7)) / math.comb(t, m),
    }
    for name, value in want.items():
        assert r[name] == pytest.approx(value, rel=1e-9), name
    assert r["PPMI"] == max(0, r["PMI"]) and r["LLR2"] == pytest.approx(r["LLR"] ** 2)


def test_zero_cells_are_floored(scores):
    assert scores["zero_b"]["OddsRatio"] == pytest.approx(80 / EPS)
    assert scores["only_a"]["RelRisk"] == 0
    for r in scores.values():
        for m, v in r.items():
            assert v is None or not isinstance(v, float) or math.isfinite(v), m
    assert scores["negative"]["BayesLLR"] is None


def test_variants(spark, table):
    t = Cells.of()
    r = table.df.filter("Collocate = 'p'").select(bpmi_with()(t).alias("x"), bpmi_with(compat=True)(t).alias("y"), bllr_with(literal=False)(t).alias("z"), g2(t).alias("g")).first()
    assert r["y"] == pytest.approx(math.log(max(r["x"], EPS)))
    assert r["z"] > 0 and r["g"] > 0


def test_fisher_out_of_range_is_one():
    got = fisher_right_values(*(np.array([x], float) for x in (6, 1, 9, -4)))
    assert got[0] == 1.0


def test_custom_metric(table):
    register_metric("Twice", lambda t: 2.0 * t.a)
    try:
        assert {r["Twice"] for r in table.score("twice").collect()} == {2.0 * r[1] for r in ROWS}
    finally:
        del METRICS["Twice"]


def test_gravity_by_hand(spark):
    from lexweave.corpus import Corpus
    from lexweave.operators.gravity import FORMULAS, directional, gravity_analysis, lexical_gravity

    toks = "x n y x z n x y".split()
    t = Corpus.from_text(spark, " ".join(toks)).contingency("n", 2, 1)
    got = {r["Collocate"]: r["LexicalGravity"] for r in lexical_gravity(t).collect()}
    # x stands right of n at 3 and 6, left of it at 0 and 3; n, y and z stand before x; x and y stand after n
    assert got["x"] == pytest.approx(math.log(2 * 2 / 2) + math.log(2 * 3 / 3))
    assert got["z"] == float("-inf")
    sides = {r["Collocate"]: (r["Left"], r["Right"]) for r in directional(t).collect()}
    assert sides["z"] == (1.0, 0.0) and sides["x"] == (0.5, 0.5)
    assert gravity_analysis(t).count() == t.df.count()
    with pytest.raises(ValueError):
        lexical_gravity(t, "other")
    plans = {f: lexical_gravity(t, f)._jdf.queryExecution().executedPlan().toString() for f in FORMULAS}
    assert not any("prev#" in p for p in plans.values())  # no row for each pair of a word and one before it
    by = Corpus.from_texts(spark, [" ".join(toks), "n x", "x n y"], metadata={"g": ["a", "b", "b"]})
    for f in FORMULAS:  # with groups and without
        one = {r["Collocate"]: r["LexicalGravity"] for r in lexical_gravity(t, f).collect()}
        assert {r["Collocate"]: r["LexicalGravity"] for r in lexical_gravity(by.contingency("n", 2, 1, ["g"]), f).collect() if r["g"] == "a"} == pytest.approx(one)
