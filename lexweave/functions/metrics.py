"""The 52 association measures as column expressions over a contingency row.

Counts are cast to DOUBLE before any product; every denominator and every
argument of a logarithm is floored at ``EPS``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import bayes_llr, fisher_right

EPS = 2.220446049250313e-16


def log_safe(x: Column) -> Column:
    return F.log(F.greatest(x.cast("double"), F.lit(EPS)))


def log2_safe(x: Column) -> Column:
    return F.log2(F.greatest(x.cast("double"), F.lit(EPS)))


def floored(x: Column) -> Column:
    return F.greatest(x, F.lit(EPS))


class Cells(SimpleNamespace):
    """Columns a, b, c, d, m, n, k, l, N (``Total``) and E11..E22 as doubles."""

    @classmethod
    def of(cls) -> Cells:
        names = {x: x for x in ("a", "b", "c", "d", "m", "n", "k", "l", "E11", "E12", "E21", "E22")} | {"N": "Total"}
        return cls(**{x: F.col(c).cast("double") for x, c in names.items()})


@dataclass(frozen=True)
class Metric:
    """A measure: what builds its column, its family, and whether it needs tokens."""

    name: str
    family: str
    build: Callable[[Cells], Column] | None
    needs_tokens: bool = False


METRICS: dict[str, Metric] = {}


def register_metric(name: str, build: Callable[[Cells], Column], family: str = "custom", needs_tokens: bool = False) -> None:
    """Add a measure; ``build`` turns the cells into a column."""
    METRICS[name] = Metric(name, family, build, needs_tokens)


def available_metrics(family: str | None = None) -> list[str]:
    return [m.name for m in METRICS.values() if family in (None, m.family)]


def resolve(name: str) -> Metric:
    """The measure of this name, in any case."""
    if name in METRICS:
        return METRICS[name]
    for m in METRICS.values():
        if m.name.lower() == name.lower():
            return m
    raise ValueError(f"unknown metric {name!r}; available: {', '.join(METRICS)}")


def _metric(family: str, *names: str):
    def add(build: Callable[[Cells], Column]) -> Callable[[Cells], Column]:
        for n in names:
            register_metric(n, build, family)
        return build

    return add


# information theory
IT = "information"


def _pmi(t: Cells, power: float) -> Column:
    joint = log_safe(t.a) if power == 1 else power * log_safe(t.a)
    return joint - log_safe(t.N) - (log_safe(t.k) + log_safe(t.m) - log_safe(t.N))


@_metric(IT, "PMI")
def pmi(t: Cells) -> Column:
    return _pmi(t, 1.0)


@_metric(IT, "PMI2")
def pmi2(t: Cells) -> Column:
    return _pmi(t, 2.0)


@_metric(IT, "PMI3")
def pmi3(t: Cells) -> Column:
    return _pmi(t, 3.0)


@_metric(IT, "PPMI")
def ppmi(t: Cells) -> Column:
    return F.greatest(F.lit(0.0), _pmi(t, 1.0))


def _sum(*xs: Column) -> Column:
    total = xs[0]
    for x in xs[1:]:
        total = total + x
    return total


def _pairs(t: Cells) -> list[tuple[Column, Column]]:
    return [(t.a, t.E11), (t.b, t.E12), (t.c, t.E21), (t.d, t.E22)]


@_metric(IT, "LLR")
def llr(t: Cells) -> Column:
    observed = _sum(*[o * log_safe(o) for o, _ in _pairs(t)])
    return 2.0 * (observed - _sum(*[o * log_safe(e) for o, e in _pairs(t)]))


@_metric(IT, "LLR2")
def llr2(t: Cells) -> Column:
    return llr(t) * llr(t)


def g2(t: Cells) -> Column:
    """Kept beside the registered measures: cells of 0 and less add nothing."""
    return 2.0 * _sum(*[F.when(o > 0, o * F.log(o / floored(e))).otherwise(0.0) for o, e in _pairs(t)])


def bpmi_with(smooth: float = 0.5, compat: bool = False) -> Callable[[Cells], Column]:
    """Smoothed PMI; ``compat`` takes the logarithm twice."""

    def build(t: Cells) -> Column:
        ratio = ((t.a + smooth) * (t.N + 4 * smooth)) / floored((t.m + 2 * smooth) * (t.k + 2 * smooth))
        return log_safe(log_safe(ratio)) if compat else log_safe(ratio)

    return build


register_metric("BPMI", bpmi_with(), IT)


def bllr_with(smooth: float = 0.5, literal: bool = True) -> Callable[[Cells], Column]:
    """Smoothed likelihood ratio.

    ``literal`` takes the row terms less the pooled ones, each cell over what it
    expects, and floors at 0; as the row terms are 0 this leaves 0 for most
    rows.  Otherwise the pooled terms themselves, which is the usual ratio.
    """

    def term(x: Column, base: Column) -> Column:
        return F.when(x > 0, x * log_safe(x / floored(base))).otherwise(0.0)

    def build(t: Cells) -> Column:
        a, b, c, d = (x + smooth for x in (t.a, t.b, t.c, t.d))
        m, n = a + b, c + d
        p, p1, p2 = (a + c) / _nonzero(m + n), a / _nonzero(m), c / _nonzero(n)
        pooled = _sum(term(a, m * p), term(b, m * (1.0 - p)), term(c, n * p), term(d, n * (1.0 - p)))
        if not literal:
            return F.greatest(F.lit(0.0), 2.0 * pooled)
        own = _sum(term(a, m * p1), term(b, m * (1.0 - p1)), term(c, n * p2), term(d, n * (1.0 - p2)))
        return F.greatest(F.lit(0.0), 2.0 * (own - pooled))

    return build


def _nonzero(x: Column) -> Column:
    return F.when(x == 0, F.lit(EPS)).otherwise(x)


register_metric("BLLR", bllr_with(), IT)
register_metric("BayesLLR", lambda t: bayes_llr(t.a, t.b, t.c, t.d), IT)

# statistics
ST = "statistical"
register_metric("FisherRight", lambda t: fisher_right(t.a, t.b, t.c, t.d), ST)


@_metric(ST, "MinSens")
def min_sens(t: Cells) -> Column:
    return F.least(t.a / floored(t.m), t.d / floored(t.n))


@_metric(ST, "ChiSquare")
def chi_square(t: Cells) -> Column:
    return _sum(*[(o - floored(e)) * (o - floored(e)) / floored(e) for o, e in _pairs(t)])


@_metric(ST, "Tscore")
def t_score(t: Cells) -> Column:
    return (t.a - t.m * t.k / floored(t.N)) / F.sqrt(floored(t.a))


@_metric(ST, "Zscore")
def z_score(t: Cells) -> Column:
    n = floored(t.N)
    e = t.m * t.k / n
    return (t.a - e) / F.sqrt(floored(e * (1.0 - t.m / n) * (1.0 - t.k / n)))


@_metric(ST, "PhiCoef")
def phi(t: Cells) -> Column:
    return (t.a * t.d - t.b * t.c) / F.sqrt(F.greatest((t.a + t.b) * (t.c + t.d) * (t.a + t.c) * (t.b + t.d), F.lit(0.0)) + EPS)


@_metric(ST, "CramersV", "TschuprowT")
def cramers_v(t: Cells) -> Column:
    return F.sqrt(F.greatest(chi_square(t), F.lit(0.0)) / floored(t.N))


@_metric(ST, "ContCoef")
def cont_coef(t: Cells) -> Column:
    x = F.greatest(chi_square(t), F.lit(0.0))
    return F.sqrt(x / floored(x + F.greatest(t.N, F.lit(0.0))))


@_metric(ST, "PiatetskyShapiro")
def piatetsky_shapiro(t: Cells) -> Column:
    return t.a / floored(t.N) - t.k * t.m / floored(t.N * t.N)


@_metric(ST, "YuleOmega")
def yule_omega(t: Cells) -> Column:
    x, y = (F.sqrt(F.greatest(p, F.lit(0.0))) for p in (t.a * t.d, t.b * t.c))
    return (x - y) / floored(x + y)


@_metric(ST, "YuleQ")
def yule_q(t: Cells) -> Column:
    return (t.a * t.d - t.b * t.c) / floored(t.a * t.d + t.b * t.c)


# similarity
SI = "similarity"
register_metric("GoodmanKruskalIdx", yule_q, SI)


@_metric(SI, "Dice")
def dice(t: Cells) -> Column:
    return 2.0 * t.a / floored(t.m + t.k)


@_metric(SI, "CzekanowskiDiceCoef")
def czekanowski(t: Cells) -> Column:
    return 2.0 * t.a / floored(2.0 * t.a + t.b + t.c)


@_metric(SI, "LogDice")
def log_dice(t: Cells) -> Column:
    return 14.0 + log2_safe(2.0 * t.a) - log2_safe(t.m + t.k)


@_metric(SI, "JaccardIdx", "GowerCoef")
def jaccard(t: Cells) -> Column:
    return t.a / floored(t.a + t.b + t.c)


@_metric(SI, "TanimotoCoef")
def tanimoto(t: Cells) -> Column:
    return t.a / floored(t.m + t.k - t.a)


@_metric(SI, "OchiaiIdx", "CosineSim")
def ochiai(t: Cells) -> Column:
    return t.a / F.sqrt(floored(t.m * t.k))


@_metric(SI, "OverlapCoef")
def overlap(t: Cells) -> Column:
    return t.a / floored(F.least(t.m, t.k))


@_metric(SI, "KulczynskiSim")
def kulczynski(t: Cells) -> Column:
    return 0.5 * (t.a / floored(t.m) + t.a / floored(t.k))


@_metric(SI, "RogersTanimotoCoef", "SokalSneathIdx", "MountfordCoef")
def rogers_tanimoto(t: Cells) -> Column:
    return t.a / floored(t.a + 2.0 * (t.b + t.c))


@_metric(SI, "RogersTanimotoCoef2", "GowerCoef2")
def rogers_tanimoto2(t: Cells) -> Column:
    return (t.a + t.d) / floored(t.a + t.d + 2.0 * (t.b + t.c))


@_metric(SI, "HammanSim")
def hamman(t: Cells) -> Column:
    return ((t.a + t.d) - (t.b + t.c)) / floored(t.N)


@_metric(SI, "HammanSim2")
def hamman2(t: Cells) -> Column:
    return (t.a - t.d) / floored(t.a + t.b + t.c - t.d)


@_metric(SI, "SorgenfreyIdx")
def sorgenfrey(t: Cells) -> Column:
    return (2.0 * t.a - t.b - t.c) / floored(2.0 * t.a + t.b + t.c)


@_metric(SI, "SorgenfreyIdx2")
def sorgenfrey2(t: Cells) -> Column:
    return (t.a + t.d) / floored(2.0 * (t.a + t.d) + t.b + t.c)


@_metric(SI, "MountfordCoef2")
def mountford2(t: Cells) -> Column:
    return (t.a + t.d) / floored((t.a + t.d) + 2.0 * F.sqrt(F.greatest((t.b + t.c) * (t.k + t.m), F.lit(0.0))))


@_metric(SI, "SokalMichenerCoef")
def sokal_michener(t: Cells) -> Column:
    return (t.a + t.d) / floored(t.N)


# epidemiology
EP = "epidemiological"


@_metric(EP, "RelRisk")
def rel_risk(t: Cells) -> Column:
    return t.a * t.n / floored(t.c * t.m)


@_metric(EP, "LogRelRisk")
def log_rel_risk(t: Cells) -> Column:
    return log_safe(t.a) + log_safe(t.n) - log_safe(t.c) - log_safe(t.m)


@_metric(EP, "RiskDiff", "AttrRisk")
def risk_diff(t: Cells) -> Column:
    return t.a / floored(t.m) - t.c / floored(t.n)


@_metric(EP, "OddsRatio")
def odds_ratio(t: Cells) -> Column:
    return t.a * t.d / floored(t.b * t.c)


@_metric(EP, "LogOddsRatio")
def log_odds_ratio(t: Cells) -> Column:
    return log_safe(t.a) + log_safe(t.d) - log_safe(t.b) - log_safe(t.c)


# direction
DI = "directional"
register_metric("DeltaPiRight", risk_diff, DI)


@_metric(DI, "DeltaPiLeft")
def delta_pi_left(t: Cells) -> Column:
    return t.a / floored(t.k) - t.b / floored(t.l)


METRICS["LexicalGravity"] = Metric("LexicalGravity", DI, None, needs_tokens=True)
