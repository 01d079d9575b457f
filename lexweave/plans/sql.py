"""DuckDB SQL that says the same as the operators, written on its own: exploded tokens, windows and joins."""

from __future__ import annotations

from collections.abc import Sequence

EPS = "2.220446049250313e-16"

TOKENS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(text, '\p{P}+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def tidy(x: str) -> str:
    """Rounded to about nine digits, in steps that both engines do alike."""
    return f"CASE WHEN abs({x}) < 1e3 THEN floor(({x}) * 1e6 + 0.5) / 1e6 WHEN abs({x}) < 1e9 THEN floor(({x}) * 1e3 + 0.5) / 1e3 WHEN abs({x}) < 1e15 THEN floor(({x}) / 1e3 + 0.5) * 1e3 ELSE {x} END"


def docs_cte(source: str = "SELECT doc_id, text FROM documents", keep: str = "") -> str:
    return f"docs AS (SELECT doc_id{keep}, {TOKENS} AS toks FROM ({source}))"


def one_node(name: str, node: str, window: int, by: str | None) -> str:
    """CTEs that end in ``ct_<name>``: counts of one node by document."""
    words = node.split()
    n = len(words)
    key = f"{by}, " if by else ""
    order = "OVER (PARTITION BY doc_id ORDER BY pos"
    start = " AND ".join([f"w = '{words[0]}'", *[f"lead(w, {i}) {order}) IS NOT DISTINCT FROM '{x}'" for i, x in enumerate(words[1:], 1)]])

    def near(frame: str) -> str:
        return f"coalesce(sum(st) {order} ROWS BETWEEN {frame}), 0)"

    return f"""
t_{name} AS (SELECT {key}doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM docs WHERE list_contains(toks, '{words[0]}')),
s_{name} AS (SELECT *, ({start})::INT AS st FROM t_{name}),
m_{name} AS (SELECT *, {near(f"1 FOLLOWING AND {window} FOLLOWING")} + {near(f"{n + window - 1} PRECEDING AND {n} PRECEDING")} > 0 AS ctx, {near(f"{n - 1} PRECEDING AND CURRENT ROW")} > 0 AS own FROM s_{name}),
a_{name} AS (SELECT {key}doc_id, w, sum(ctx::INT) AS a, sum((NOT ctx AND NOT own)::INT) AS c FROM m_{name} GROUP BY ALL),
r_{name} AS (SELECT doc_id, sum(CASE WHEN a > 0 THEN 0 ELSE c END) AS r FROM a_{name} GROUP BY doc_id),
f_{name} AS (SELECT doc_id, sum(st) AS f FROM s_{name} GROUP BY doc_id),
u_{name} AS (SELECT o.doc_id, x.w, count(DISTINCT o.pos) AS u FROM s_{name} o JOIN s_{name} x ON o.doc_id = x.doc_id AND o.st = 1 AND (x.pos BETWEEN o.pos - {window} AND o.pos - 1 OR x.pos BETWEEN o.pos + {n} AND o.pos + {n + window - 1}) GROUP BY ALL),
ct_{name} AS (SELECT {key}'{node}' AS "Node", w AS "Collocate", a, f - u AS b, c, r - c AS d FROM a_{name} JOIN r_{name} USING (doc_id) JOIN f_{name} USING (doc_id) JOIN u_{name} USING (doc_id, w) WHERE a > 0)"""


def contingency(nodes: Sequence[str], window: int, minfreq: int, by: str | None = None, source: str = "SELECT doc_id, text FROM documents", keep: str = "") -> str:
    """``WITH`` clause that ends in ``cells``: a, b, c, d, DocFrequency, margins and expected counts."""
    key = f"{by}, " if by else ""
    parts = ",".join(one_node(f"n{i}", n, window, by) for i, n in enumerate(nodes))
    union = " UNION ALL ".join(f"SELECT * FROM ct_n{i}" for i in range(len(nodes)))
    return f"""
WITH {docs_cte(source, keep)},{parts},
summed AS (SELECT {key}"Node", "Collocate", sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d, count(*) AS "DocFrequency" FROM ({union}) GROUP BY ALL HAVING sum(a) >= {minfreq}),
wide AS (SELECT *, a + b AS m, c + d AS n, a + c AS k, b + d AS l, a + b + c + d AS "Total" FROM summed),
cells AS (SELECT *, CASE WHEN "Total" = 0 THEN 0 ELSE m::DOUBLE * k::DOUBLE / "Total"::DOUBLE END AS e11, CASE WHEN "Total" = 0 THEN 0 ELSE m::DOUBLE * l::DOUBLE / "Total"::DOUBLE END AS e12, CASE WHEN "Total" = 0 THEN 0 ELSE n::DOUBLE * k::DOUBLE / "Total"::DOUBLE END AS e21, CASE WHEN "Total" = 0 THEN 0 ELSE n::DOUBLE * l::DOUBLE / "Total"::DOUBLE END AS e22 FROM wide),
dbl AS (SELECT {key}"Node", "Collocate", a AS "Frequency", "DocFrequency", a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, m::DOUBLE AS m, n::DOUBLE AS n, k::DOUBLE AS k, l::DOUBLE AS l, "Total"::DOUBLE AS nn, e11, e12, e21, e22 FROM cells)
"""


def lns(x: str) -> str:
    return f"ln(greatest({x}, {EPS}))"


def eps(x: str) -> str:
    return f"greatest({x}, {EPS})"


_PMI = f"({lns('a')} - {lns('nn')} - ({lns('k')} + {lns('m')} - {lns('nn')}))"
_LLR = "2.0 * ((" + " + ".join(f"{o} * {lns(o)}" for o in "abcd") + ") - (" + " + ".join(f"{o} * {lns(e)}" for o, e in zip("abcd", ("e11", "e12", "e21", "e22"), strict=True)) + "))"
_CHI = "(" + " + ".join(f"({o} - {eps(e)}) * ({o} - {eps(e)}) / {eps(e)}" for o, e in zip("abcd", ("e11", "e12", "e21", "e22"), strict=True)) + ")"


def _power(n: str) -> str:
    return f"{n} * {lns('a')} - {lns('nn')} - ({lns('k')} + {lns('m')} - {lns('nn')})"


def _lbeta(x: str, y: str) -> str:
    return f"(lgamma({x}) + lgamma({y}) - lgamma({x} + {y}))"


def _bllr() -> str:
    z = lambda x: f"(CASE WHEN {x} = 0 THEN {EPS} ELSE {x} END)"
    a, b, c, d = ("(a + 0.5)", "(b + 0.5)", "(c + 0.5)", "(d + 0.5)")
    m, n = f"({a} + {b})", f"({c} + {d})"
    p, p1, p2 = f"(({a} + {c}) / {z(f'({m} + {n})')})", f"({a} / {z(m)})", f"({c} / {z(n)})"
    term = lambda x, base: f"(CASE WHEN {x} > 0 THEN {x} * {lns(f'{x} / {eps(base)}')} ELSE 0.0 END)"
    pooled = " + ".join([term(a, f"{m} * {p}"), term(b, f"{m} * (1.0 - {p})"), term(c, f"{n} * {p}"), term(d, f"{n} * (1.0 - {p})")])
    own = " + ".join([term(a, f"{m} * {p1}"), term(b, f"{m} * (1.0 - {p1})"), term(c, f"{n} * {p2}"), term(d, f"{n} * (1.0 - {p2})")])
    return f"greatest(0.0, 2.0 * (({own}) - ({pooled})))"


_Z_E = f"(m * k / {eps('nn')})"

METRIC_SQL = {
    "PMI": _PMI, "PMI2": _power("2.0"), "PMI3": _power("3.0"), "PPMI": f"greatest(0.0, {_PMI})", "LLR": _LLR, "LLR2": f"({_LLR}) * ({_LLR})",
    "BPMI": lns(f"((a + 0.5) * (nn + 2.0)) / {eps('(m + 1.0) * (k + 1.0)')}"), "BLLR": _bllr(),
    "MinSens": f"least(a / {eps('m')}, d / {eps('n')})", "ChiSquare": _CHI, "Tscore": f"(a - m * k / {eps('nn')}) / sqrt({eps('a')})",
    "Zscore": f"(a - {_Z_E}) / sqrt({eps(f'{_Z_E} * (1.0 - m / {eps("nn")}) * (1.0 - k / {eps("nn")})')})",
    "PhiCoef": f"(a * d - b * c) / sqrt(greatest((a + b) * (c + d) * (a + c) * (b + d), 0.0) + {EPS})",
    "CramersV": f"sqrt(greatest({_CHI}, 0.0) / {eps('nn')})", "TschuprowT": f"sqrt(greatest({_CHI}, 0.0) / {eps('nn')})",
    "ContCoef": f"sqrt(greatest({_CHI}, 0.0) / {eps(f'greatest({_CHI}, 0.0) + greatest(nn, 0.0)')})", "PiatetskyShapiro": f"a / {eps('nn')} - k * m / {eps('nn * nn')}",
    "YuleOmega": f"(sqrt(greatest(a * d, 0.0)) - sqrt(greatest(b * c, 0.0))) / {eps('sqrt(greatest(a * d, 0.0)) + sqrt(greatest(b * c, 0.0))')}",
    "YuleQ": f"(a * d - b * c) / {eps('a * d + b * c')}", "GoodmanKruskalIdx": f"(a * d - b * c) / {eps('a * d + b * c')}",
    "Dice": f"2.0 * a / {eps('m + k')}", "CzekanowskiDiceCoef": f"2.0 * a / {eps('2.0 * a + b + c')}", "LogDice": f"14.0 + log2({eps('2.0 * a')}) - log2({eps('m + k')})",
    "JaccardIdx": f"a / {eps('a + b + c')}", "GowerCoef": f"a / {eps('a + b + c')}", "TanimotoCoef": f"a / {eps('m + k - a')}", "OchiaiIdx": f"a / sqrt({eps('m * k')})", "CosineSim": f"a / sqrt({eps('m * k')})",
    "OverlapCoef": f"a / {eps('least(m, k)')}", "KulczynskiSim": f"0.5 * (a / {eps('m')} + a / {eps('k')})",
    "RogersTanimotoCoef": f"a / {eps('a + 2.0 * (b + c)')}", "SokalSneathIdx": f"a / {eps('a + 2.0 * (b + c)')}", "MountfordCoef": f"a / {eps('a + 2.0 * (b + c)')}",
    "RogersTanimotoCoef2": f"(a + d) / {eps('a + d + 2.0 * (b + c)')}", "GowerCoef2": f"(a + d) / {eps('a + d + 2.0 * (b + c)')}", "HammanSim": f"((a + d) - (b + c)) / {eps('nn')}", "HammanSim2": f"(a - d) / {eps('a + b + c - d')}",
    "SorgenfreyIdx": f"(2.0 * a - b - c) / {eps('2.0 * a + b + c')}", "SorgenfreyIdx2": f"(a + d) / {eps('2.0 * (a + d) + b + c')}",
    "MountfordCoef2": f"(a + d) / {eps('(a + d) + 2.0 * sqrt(greatest((b + c) * (k + m), 0.0))')}", "SokalMichenerCoef": f"(a + d) / {eps('nn')}",
    "RelRisk": f"a * n / {eps('c * m')}", "LogRelRisk": f"{lns('a')} + {lns('n')} - {lns('c')} - {lns('m')}", "RiskDiff": f"a / {eps('m')} - c / {eps('n')}", "AttrRisk": f"a / {eps('m')} - c / {eps('n')}",
    "OddsRatio": f"a * d / {eps('b * c')}", "LogOddsRatio": f"{lns('a')} + {lns('d')} - {lns('b')} - {lns('c')}", "DeltaPiRight": f"a / {eps('m')} - c / {eps('n')}", "DeltaPiLeft": f"a / {eps('k')} - b / {eps('l')}",
    "BayesLLR": f"CASE WHEN d + 0.5 > 0 AND b + 0.5 > 0 THEN 2.0 * ({_lbeta('(a + 0.5)', '(b + 0.5)')} + {_lbeta('(c + 0.5)', '(d + 0.5)')} - {_lbeta('(a + c + 0.5)', '(b + d + 0.5)')} - {_lbeta('0.5', '0.5')}) END",
    "FisherRight": "CASE WHEN m >= 0 AND n >= 0 AND k >= 0 AND k <= nn AND nn > 0 AND greatest(0, k - n) <= least(m, k) THEN least(1.0, list_sum(list_transform(range(greatest(least(a, least(m, k)), greatest(0, k - n))::BIGINT, least(m, k)::BIGINT + 1), lambda x: exp(lgamma(m + 1) - lgamma(x + 1.0) - lgamma(m - x + 1) + lgamma(n + 1) - lgamma(k - x + 1) - lgamma(n - k + x + 1) - lgamma(nn + 1) + lgamma(k + 1) + lgamma(nn - k + 1))))) ELSE 1.0 END",
}


def score(metrics: Sequence[str], *keys: str, where: str = "") -> str:
    names = ", ".join([*keys, '"Node"', '"Collocate"', '"Frequency"'])
    return f"SELECT {names}, " + ", ".join(f'{tidy(f"val_{m}")} AS "{m}"' for m in metrics) + f" FROM (SELECT *, {', '.join(f'{METRIC_SQL[m]} AS val_{m}' for m in metrics)} FROM dbl) {where}"


def token_table(source: str = "SELECT doc_id, text FROM documents") -> str:
    return f"WITH {docs_cte(source)}, tok AS (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM docs), freq AS (SELECT w, count(*) AS f, count(DISTINCT doc_id) AS df FROM tok GROUP BY w)"
