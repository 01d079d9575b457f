"""Registered queries of the engine's own operators, each over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions import text as T
from ..functions.agg import tidy
from ..functions.metrics import available_metrics
from ..functions.text import TextNorm
from ..operators import compare, gravity, keywords, kwic, network, recipes, stats, subcorpus, temporal
from ..operators.contingency import Contingency
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NORM = TextNorm(assume_form=True)  # the tables are in NFC already
NODES = ["the", "de", "of"]
STOP = ["the", "of", "and", "to", "in", "a", "is", "de", "la", "und"]
YEAR = "(2015 + doc_id % 10)::INT"


def tidied(df: DataFrame) -> DataFrame:
    return df.select(*[tidy(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> Corpus:
    """``documents``, of which only the columns that are needed are read."""
    return Corpus(table(spark, sf_dir, "documents").select("doc_id", "text", *extra), NORM)


def dated(spark: SparkSession, sf_dir: str) -> Corpus:
    c = corpus(spark, sf_dir)
    return c.over(c.df.withColumn("year", (2015 + F.col("doc_id") % 10).cast("int")))


_CELLS = 'a, b, c, d, m, n, k, l, "Total"'
_EXPECT = ", ".join(f'{S.tidy(e.lower())} AS "{e}"' for e in ("E11", "E12", "E21", "E22"))


def _cells(t: Contingency) -> DataFrame:
    return tidied(t.df.select(*t.keys, "a", "b", "c", "d", "m", "n", "k", "l", "Total", "E11", "E12", "E21", "E22", "DocFrequency"))


@query(S.contingency(["the"], 5, 5) + f'SELECT "Node", "Collocate", {_CELLS}, {_EXPECT}, "DocFrequency" FROM cells')
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(corpus(spark, sf_dir).contingency("the", 5, 5))


@query(S.contingency(["of the", "in the"], 4, 2) + f'SELECT "Node", "Collocate", {_CELLS}, {_EXPECT}, "DocFrequency" FROM cells')
def contingency_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(corpus(spark, sf_dir).contingency(["of the", "in the"], 4, 2))


@query(S.contingency(NODES, 3, 5, "lang", "SELECT doc_id, text, lang FROM documents", ", lang") + f'SELECT lang, "Node", "Collocate", {_CELLS}, {_EXPECT}, "DocFrequency" FROM cells')
def contingency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(corpus(spark, sf_dir, ("lang",)).contingency(NODES, 3, 5, by=["lang"]))


_CONV = "SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations"


@query(S.contingency(["the"], 5, 1, None, _CONV).split(",\nsummed")[0] + ' SELECT doc_id, "Node", w AS "Collocate", a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d FROM (SELECT doc_id, \'the\' AS "Node", w, a, f - u AS b, c, r - c AS d FROM a_n0 JOIN r_n0 USING (doc_id) JOIN f_n0 USING (doc_id) JOIN u_n0 USING (doc_id, w) WHERE a > 0)')
def contingency_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return Corpus(turns, NORM).document_contingency("the", 5, 1).df.select("doc_id", "Node", "Collocate", "a", "b", "c", "d")


def _family(family: str) -> list[str]:
    return [m for m in available_metrics(family) if m in S.METRIC_SQL and m not in ("BayesLLR", "FisherRight")]


def _metrics(name: str, metrics: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidied(corpus(spark, sf_dir).contingency(["the", "of"], 5, 5).score(metrics))

    run.__name__ = name
    query(S.contingency(["the", "of"], 5, 5) + S.score(metrics))(run)


for _f in ("information", "statistical", "similarity", "epidemiological", "directional"):
    _metrics(f"metrics_{_f}", _family(_f))
_metrics("bayes_fisher", ["BayesLLR", "FisherRight"])


def _gravity_sql(formula: str) -> str:
    w = 5
    base = S.contingency(["the"], w, 5)
    return base + f"""
, g_all AS (SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM docs),
g_right AS (SELECT x.w, count(*) AS n FROM g_all o JOIN g_all x ON o.doc_id = x.doc_id AND o.w = 'the' AND x.pos BETWEEN o.pos + 1 AND o.pos + {w} GROUP BY 1),
g_left AS (SELECT x.w, count(*) AS n, count(DISTINCT (x.doc_id, x.pos)) AS covered FROM g_all o JOIN g_all x ON o.doc_id = x.doc_id AND o.w = 'the' AND x.pos BETWEEN o.pos - {w} AND o.pos - 1 GROUP BY 1),
g_f AS (SELECT w, count(*) AS f FROM g_all GROUP BY 1),
g_before AS (SELECT w, count(DISTINCT p) AS types FROM ({" UNION ALL ".join(f"SELECT w, lag(w, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM g_all" for i in range(1, w + 1))}) WHERE p IS NOT NULL GROUP BY 1),
g_node AS (SELECT (SELECT f FROM g_f WHERE w = 'the') AS f_node, (SELECT count(*) FROM g_right) AS types_right, (SELECT count(*) FROM g_all) AS n_all),
g AS (SELECT "Node", "Collocate", a, coalesce(r.n, 0)::DOUBLE AS n_right, coalesce(lf.n, 0)::DOUBLE AS n_left, coalesce(lf.covered, 0)::DOUBLE AS covered, f::DOUBLE AS f_coll, coalesce(types, 0)::DOUBLE AS types_before, f_node::DOUBLE AS f_node, types_right::DOUBLE AS types_right, n_all::DOUBLE AS n_all
  FROM dbl LEFT JOIN g_right r ON r.w = "Collocate" LEFT JOIN g_left lf ON lf.w = "Collocate" LEFT JOIN g_f gf ON gf.w = "Collocate" LEFT JOIN g_before gb ON gb.w = "Collocate" CROSS JOIN g_node),
v AS (SELECT *, {formula} AS val FROM g)
"""


_ORIGINAL = "CASE WHEN n_right > 0 AND covered > 0 AND types_right > 0 AND types_before > 0 THEN ln(n_right * types_right / f_node) + ln(covered * types_before / f_coll) END"
_SIMPLE = f"2.0 * log2({S.eps('a')}) + log2(10.0) - log2(f_node) - log2(f_coll)"
_WEIGHTED = f"a * {S.lns('a * n_all / (f_node * f_coll)')}"


def _gravity(spark: SparkSession, sf_dir: str, formula: str) -> DataFrame:
    got = gravity.lexical_gravity(corpus(spark, sf_dir).contingency("the", 5, 5), formula)
    return tidied(got.withColumn("LexicalGravity", F.when(F.col("LexicalGravity") > float("-inf"), F.col("LexicalGravity"))))


_G_OUT = f'SELECT "Node", "Collocate", {S.tidy("val")} AS "LexicalGravity" FROM v'


@query(_gravity_sql(_ORIGINAL) + _G_OUT)
def lexical_gravity_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gravity(spark, sf_dir, "original")


@query(_gravity_sql(_SIMPLE) + _G_OUT)
def lexical_gravity_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gravity(spark, sf_dir, "simplified")


@query(_gravity_sql(_WEIGHTED) + _G_OUT)
def lexical_gravity_pmi_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gravity(spark, sf_dir, "pmi_weighted")


@query(_gravity_sql("NULL") + ", dir AS (SELECT *, n_left / (n_left + n_right) AS l, n_right / (n_left + n_right) AS r, (n_right - n_left) / (n_left + n_right) AS y FROM v) " + f'SELECT "Node", "Collocate", {S.tidy("l")} AS "Left", {S.tidy("r")} AS "Right", {S.tidy("y")} AS "Asymmetry" FROM dir')
def gravity_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(gravity.directional(corpus(spark, sf_dir).contingency("the", 5, 5)))


_ANALYZE = ["PMI", "LLR", "LogDice"]


@query(S.contingency(["the"], 5, 5) + S.score(_ANALYZE, '"DocFrequency"'))
def analyze_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(corpus(spark, sf_dir).analyze_node("the", _ANALYZE).df)


def _top(n: int, by: str = "") -> str:
    return f', sc AS ({S.score(_ANALYZE, *filter(None, [by]), chr(34) + "DocFrequency" + chr(34))}), rk AS (SELECT *, row_number() OVER (PARTITION BY {by + ", " if by else ""}"Node" ORDER BY "PMI" DESC, "Collocate") AS i FROM sc) SELECT * EXCLUDE (i) FROM rk WHERE i <= {n}'


@query(S.contingency(NODES, 5, 5) + _top(100))
def analyze_nodes_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ranked by the rounded score, so that engines agree on ties
    scored = tidied(corpus(spark, sf_dir).contingency(NODES, 5, 5).score(_ANALYZE, doc_frequency=True))
    order = Window.partitionBy("Node").orderBy(F.desc("PMI"), "Collocate")
    return scored.withColumn("i", F.row_number().over(order)).filter("i <= 100").drop("i")


_STATS = (
    S.token_table("SELECT doc_id, strip_accents(text) AS text FROM documents")
    + """, cum AS (SELECT *, row_number() OVER (ORDER BY f DESC, w) AS r, sum(f) OVER (ORDER BY f DESC, w ROWS UNBOUNDED PRECEDING) AS c FROM freq),
tot AS (SELECT sum(f)::BIGINT AS T, count(*) AS V FROM freq),
dl AS (SELECT len(toks)::BIGINT AS n FROM docs),
dd AS (SELECT count(*) AS num_documents, avg(n) AS avg_doc_length, median(n) AS median_doc_length, min(n) AS min_doc_length, max(n) AS max_doc_length, stddev_samp(n) AS std_doc_length FROM dl),
tt AS (SELECT sum((f = 1)::INT)::BIGINT AS hapax_count, avg(f) AS mean_type_frequency, median(f) AS median_type_frequency, max(f) AS max_type_frequency, min(f) AS min_type_frequency FROM freq),
zz AS (SELECT CASE WHEN count(*) > 10 THEN abs(regr_slope(ln(f), ln(r))) END AS zipf_exponent FROM cum WHERE r <= 1000),
ww AS (SELECT """
    + ", ".join(f"min(CASE WHEN c >= ceil(round({p / 100} * T, 6)) THEN r END) AS words_for_{p}" for p in stats.COVERAGES)
    + " FROM cum, tot), al AS (SELECT * FROM dd, tt, zz, ww, tot) SELECT num_documents, "
    + ", ".join(f"{S.tidy(x)} AS {x}" for x in ("avg_doc_length", "median_doc_length", "std_doc_length", "mean_type_frequency", "median_type_frequency", "zipf_exponent"))
    + ", min_doc_length, max_doc_length, T AS total_tokens, V AS vocabulary_size, hapax_count, max_type_frequency, min_type_frequency, "
    + ", ".join(f"words_for_{p}" for p in stats.COVERAGES)
    + f", {S.tidy('V::DOUBLE / T')} AS type_token_ratio, {S.tidy('V::DOUBLE / T * sqrt(T)')} AS root_ttr, {S.tidy('hapax_count::DOUBLE / V')} AS hapax_ratio, "
    + ", ".join(f"{S.tidy(f'words_for_{p}::DOUBLE / V')} AS coverage_ratio_{p}" for p in stats.COVERAGES)
    + " FROM al"
)


@query(_STATS)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(stats.corpus_stats(corpus(spark, sf_dir)))


@query(S.token_table() + f", x AS (SELECT w, f, df, df::DOUBLE / (SELECT count(*) FROM docs) AS dr, f::DOUBLE / (SELECT sum(f) FROM freq)::DOUBLE AS rf, ln((SELECT count(*) FROM docs)::DOUBLE / df) AS idf FROM freq), y AS (SELECT *, f * idf AS ti FROM x) SELECT w AS \"Token\", f AS \"Frequency\", df AS \"DocFrequency\", {S.tidy('dr')} AS \"DocFrequencyRatio\", {S.tidy('rf')} AS \"RelativeFrequency\", {S.tidy('idf')} AS \"IDF\", {S.tidy('ti')} AS \"TFIDF\" FROM y")
def token_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(stats.token_distribution(corpus(spark, sf_dir)))


@query(S.token_table() + f""", cum AS (SELECT *, row_number() OVER (ORDER BY f DESC, w) AS r, sum(f) OVER (ORDER BY f DESC, w ROWS UNBOUNDED PRECEDING) AS c FROM freq), tot AS (SELECT sum(f) AS t, count(*) AS v FROM freq),
p AS (SELECT i / 100.0::DOUBLE AS p FROM range(1, 101) x(i)), need AS (SELECT p, min(r) AS r FROM p, tot, cum WHERE c >= ceil(round(p * t, 6)) GROUP BY p)
SELECT {S.tidy('p')} AS "Percentile", r AS "WordsNeeded", {S.tidy('r::DOUBLE / v')} AS "ProportionOfVocab", (SELECT c FROM cum WHERE cum.r = need.r)::BIGINT AS "CumulativeTokens" FROM need, tot""")
def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(stats.vocab_coverage(corpus(spark, sf_dir)))


@query(S.token_table() + " SELECT doc_id, w AS token, count(*) AS tf FROM tok GROUP BY ALL")
def doc_term_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).document_term_matrix()


@query(S.token_table() + ", fo AS (SELECT w, min((doc_id, pos)) AS p FROM tok GROUP BY w) SELECT w AS token, row_number() OVER (ORDER BY p) AS idx FROM fo")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).vocabulary()


_TEMPORAL_DOCS = f"SELECT doc_id, text, least(floor(({YEAR} - 2015) / 1.8)::INT + 1, 5) AS \"Period\" FROM documents"
_PERIODS = S.contingency(["the", "of"], 5, 5, '"Period"', _TEMPORAL_DOCS, ', "Period"')
_LABEL = """CASE "Period" WHEN 1 THEN '2015.0-2016.8' WHEN 2 THEN '2016.8-2018.6' WHEN 3 THEN '2018.6-2020.4' WHEN 4 THEN '2020.4-2022.2' ELSE '2022.2-2024.0' END"""


def _temporal(spark: SparkSession, sf_dir: str) -> temporal.Temporal:
    return temporal.analyze_temporal(dated(spark, sf_dir), ["the", "of"], "year", "PMI", 5, 5, 5, None)


@query(_PERIODS + f'SELECT "Period", {_LABEL} AS "PeriodLabel", "Node", "Collocate", "Frequency", "DocFrequency", {S.tidy("pmi")} AS "PMI" FROM (SELECT *, {S.METRIC_SQL["PMI"]} AS pmi FROM dbl)')
def temporal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(_temporal(spark, sf_dir).scores)


_SCORED = f', sc AS (SELECT *, {S.METRIC_SQL["PMI"]} AS y FROM dbl)'
_TREND = _SCORED + """, xs AS (SELECT "Node", "Collocate", y, row_number() OVER (PARTITION BY "Node", "Collocate" ORDER BY "Period")::DOUBLE AS x FROM sc),
tr AS (SELECT "Node", "Collocate", corr(y, x) AS r, regr_slope(y, x) AS s, avg(y) AS av, stddev_samp(y) AS sd, count(*) AS np FROM xs GROUP BY ALL HAVING count(*) > 1),
t2 AS (SELECT "Node", "Collocate", CASE WHEN sd < 1e-10 THEN 0 ELSE r END AS r, CASE WHEN sd < 1e-10 THEN 0 ELSE s END AS s, av, CASE WHEN sd < 1e-10 THEN 0 ELSE sd END AS sd, np FROM tr)
"""


@query(_PERIODS + _TREND + f'SELECT "Node", "Collocate", {S.tidy("r")} AS "Correlation", {S.tidy("s")} AS "Slope", {S.tidy("av")} AS "MeanScore", {S.tidy("sd")} AS "StdScore", np AS "NumPeriods" FROM t2')
def temporal_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(_temporal(spark, sf_dir).trends)


@query(_PERIODS + _SCORED + """, z AS (SELECT "Node", "Collocate", "Period", y, avg(y) OVER p AS av, stddev_samp(y) OVER p AS sd, count(*) OVER p AS n FROM sc WINDOW p AS (PARTITION BY "Node", "Collocate")),
zz AS (SELECT *, CASE WHEN sd > 1e-10 THEN (y - av) / sd END AS zs FROM z WHERE n >= 3), b AS (SELECT *, row_number() OVER (PARTITION BY "Node", "Collocate" ORDER BY zs DESC NULLS LAST, "Period") AS i FROM zz) """ + f'SELECT "Node", "Collocate", "Period", {S.tidy("y")} AS "Score", {S.tidy("zs")} AS "Z" FROM b WHERE i = 1 AND zs > 1.5')
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(temporal.bursts(_temporal(spark, sf_dir), 1.5))


@query(_PERIODS + """, s AS (SELECT "Node", "Collocate", max(("Period" = 1)::INT) AS x, max(("Period" = 5)::INT) AS y FROM dbl WHERE "Period" IN (1, 5) GROUP BY ALL), t AS (SELECT "Node", sum(x * y)::BIGINT AS k, sum(x * (1 - y))::BIGINT AS l, sum(y * (1 - x))::BIGINT AS g FROM s GROUP BY 1) """ + f'SELECT "Node", {S.tidy("1.0::DOUBLE - k::DOUBLE / (k + l + g)")} AS "Shift", k AS "Kept", l AS "Lost", g AS "Gained" FROM t')
def semantic_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(temporal.semantic_shift(_temporal(spark, sf_dir), 1, 5))


@query(_PERIODS + _SCORED + """, o AS (SELECT "Node", "Collocate", y FROM sc WHERE "Period" = 1), p AS (SELECT "Node", "Collocate", y FROM sc WHERE "Period" = 5), q AS (SELECT o."Node", o."Collocate", o.y AS s1, p.y AS s2, p.y - o.y AS ch, CASE WHEN o.y <> 0 THEN 100.0 * (p.y - o.y) / abs(o.y) END AS pc FROM o JOIN p ON o."Node" = p."Node" AND o."Collocate" = p."Collocate") """ + f'SELECT "Node", "Collocate", {S.tidy("s1")} AS "Score1", {S.tidy("s2")} AS "Score2", {S.tidy("ch")} AS "Change", {S.tidy("pc")} AS "PercentChange" FROM q')
def compare_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(temporal.compare_periods(_temporal(spark, sf_dir), 1, 5))


_GROUPS = S.contingency(["de"], 5, 5, '"Group"', 'SELECT doc_id, text, lang AS "Group" FROM documents', ', "Group"') + _SCORED


def _groups(spark: SparkSession, sf_dir: str) -> subcorpus.Subcorpora:
    return subcorpus.compare_subcorpora(corpus(spark, sf_dir, ("lang",)), "lang", "de", "PMI")


@query(_GROUPS + f'SELECT "Group", "Node", "Collocate", "Frequency", "DocFrequency", {S.tidy("y")} AS "PMI" FROM sc')
def subcorpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(_groups(spark, sf_dir).scores)


@query(_GROUPS + f', g AS (SELECT DISTINCT "Group" FROM docs), h AS (SELECT "Group", count(*) AS n, avg(y) AS av FROM sc GROUP BY 1) SELECT g."Group" AS "Subcorpus", coalesce(n, 0)::BIGINT AS "NumCollocates", {S.tidy("av")} AS "AvgScore" FROM g LEFT JOIN h ON g."Group" = h."Group"')
def subcorpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(_groups(spark, sf_dir).summary)


@query(_GROUPS + f', e AS (SELECT x."Collocate", x."Group" AS g1, y."Group" AS g2, x.y AS s1, y.y AS s2, x.y - y.y AS df FROM sc x JOIN sc y ON x."Collocate" = y."Collocate" AND x."Group" < y."Group") SELECT "Collocate", g1 AS "Group1", g2 AS "Group2", {S.tidy("s1")} AS "Score1", {S.tidy("s2")} AS "Score2", {S.tidy("df")} AS "Difference" FROM e')
def subcorpus_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(_groups(spark, sf_dir).effects.drop("CohensD", "EffectSize"))


_CMP = ["LLR", "LogDice", "Tscore"]
_CMP_SQL = S.contingency(["the"], 5, 5) + f", s0 AS ({S.score(_CMP)}), rk AS (SELECT *, " + ", ".join(f'rank() OVER (ORDER BY "{m}" DESC) + (count(*) OVER (PARTITION BY "{m}") - 1) / 2.0 AS r_{m}' for m in _CMP) + " FROM s0)"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(corpus(spark, sf_dir).contingency("the", 5, 5).score(_CMP))


@query(_CMP_SQL + " " + " UNION ALL ".join(f"SELECT '{a}' AS \"Metric1\", '{b}' AS \"Metric2\", {S.tidy('v')} AS \"Spearman\" FROM (SELECT corr(r_{a}, r_{b}) AS v FROM rk)" for i, a in enumerate(_CMP) for b in _CMP[i:]))
def compare_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(compare.spearman(_compared(spark, sf_dir), _CMP))


_TOPK = S.contingency(["the"], 5, 5) + f", s0 AS ({S.score(_CMP)}), o AS (SELECT *, " + ", ".join(f'row_number() OVER (ORDER BY "{m}" DESC, "Collocate") AS o_{m}' for m in _CMP) + " FROM s0) "


@query(_TOPK + " UNION ALL ".join(f"SELECT {k} AS \"K\", '{a}-{b}' AS \"Pair\", sum((o_{a} <= {k} AND o_{b} <= {k})::INT)::BIGINT AS \"Overlap\", {S.tidy(f'(sum((o_{a} <= {k} AND o_{b} <= {k})::INT)::DOUBLE / sum((o_{a} <= {k} OR o_{b} <= {k})::INT)::DOUBLE)')} AS \"Jaccard\" FROM o" for k in (10, 25, 50) for i, a in enumerate(_CMP) for b in _CMP[i + 1 :]))
def compare_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(compare.top_k_overlap(_compared(spark, sf_dir), _CMP))


@query(_CMP_SQL + ' SELECT "Collocate", (r_LLR - r_LogDice)::DOUBLE AS "RankDiff", \'LLR\' AS "Metric1", \'LogDice\' AS "Metric2" FROM rk')
def compare_rank_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.rank_differences(_compared(spark, sf_dir), ("LLR", "LogDice"))


@query(_CMP_SQL + ", bd AS (SELECT *, CASE WHEN \"Frequency\" <= 5 THEN 'rare' WHEN \"Frequency\" <= 20 THEN 'mid' ELSE 'high' END AS band FROM rk) " + " UNION ALL ".join(f"SELECT band AS \"Band\", '{a}-{b}' AS \"Pair\", {S.tidy('v')} AS \"Spearman\", n AS \"N\" FROM (SELECT band, count(*) AS n, CASE WHEN count(*) >= 2 THEN corr(r_{a}, r_{b}) END AS v FROM bd GROUP BY band)" for i, a in enumerate(_CMP) for b in _CMP[i + 1 :]))
def compare_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(compare.band_correlations(_compared(spark, sf_dir), _CMP))


@query(S.token_table() + f", x AS (SELECT w, df, f::DOUBLE / (SELECT count(*) FROM docs) * ln((SELECT count(*) FROM docs)::DOUBLE / df) AS s, df::DOUBLE / (SELECT count(*) FROM docs) AS r FROM freq WHERE df >= 3 AND df <= (SELECT count(*) FROM docs) * 0.5) SELECT w AS \"Keyword\", {S.tidy('s')} AS \"TFIDF\", df AS \"DocFreq\", {S.tidy('r')} AS \"DocFreqRatio\" FROM x")
def keyterms_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(keywords.tfidf(corpus(spark, sf_dir), None))


_STOP_SQL = "(" + ", ".join(f"'{s}'" for s in STOP) + ")"


@query(S.token_table() + f""", de AS (SELECT *, (w IN {_STOP_SQL} OR length(w) <= 1) AS cut FROM tok), ru AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM de),
ph AS (SELECT doc_id, run, string_agg(w, ' ' ORDER BY pos) AS p, count(*) AS n FROM ru WHERE NOT cut GROUP BY doc_id, run),
pf AS (SELECT p, n, count(*) AS f, count(DISTINCT doc_id) AS d FROM ph GROUP BY p, n), ea AS (SELECT p, f, n, unnest(string_split(p, ' ')) AS w FROM pf),
wo AS (SELECT w, sum(f * n)::DOUBLE / sum(f)::DOUBLE AS s FROM ea GROUP BY w), sc AS (SELECT p, sum(s) AS s FROM ea JOIN wo USING (w) GROUP BY p)
SELECT p AS "Keyword", {S.tidy('s')} AS "RAKEScore", f AS "Frequency", n AS "WordCount", d AS "DocFrequency" FROM pf JOIN sc USING (p)""")
def keyterms_rake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(keywords.rake(corpus(spark, sf_dir), None, stop=STOP))


@query()
def keyterms_textrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.textrank(corpus(spark, sf_dir), None, stop=STOP)


@query(S.token_table() + f""", ke AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM tok WHERE w NOT IN {_STOP_SQL}),
pa AS (SELECT a.w AS x, b.w AS y, count(*) AS n FROM ke a JOIN ke b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 AND a.pos <> b.pos GROUP BY ALL) SELECT x, y, 2 * n AS n FROM pa""")
def textrank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.word_pairs(corpus(spark, sf_dir), stop=STOP)


def _network(spark: SparkSession, sf_dir: str, **more) -> network.Network:
    return network.colloc_graph(corpus(spark, sf_dir), ["the", "de"], "LLR", depth=2, max_neighbors=10, **more)


@query()
def colloc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir, weight_normalization="minmax").edges


_LAYER = S.contingency(["the", "de"], 5, 5) + f", sc AS (SELECT *, {S.METRIC_SQL['LogDice']} AS y FROM dbl), bs AS (SELECT *, row_number() OVER (PARTITION BY \"Node\" ORDER BY {S.tidy('y')} DESC, \"Collocate\") AS i FROM sc WHERE y >= 0)"


@query(_LAYER + f' SELECT "Node" AS "Source", "Collocate" AS "Target", {S.tidy("y")} AS "Weight", \'LogDice\' AS "Metric", "Frequency", "DocFrequency", 0.0::DOUBLE AS "NormalizedWeight" FROM bs WHERE i <= 20')
def colloc_first_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(network.colloc_graph(corpus(spark, sf_dir), ["the", "de"], "LogDice", depth=1, max_neighbors=20).edges)


@query()
def colloc_node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir, direction="undirected").node_metrics


@query()
def colloc_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network(spark, sf_dir, compute_centrality=True, centrality_metrics=network.CENTRALITIES).node_metrics


@query(f"WITH {S.docs_cte()}, t AS (SELECT doc_id, toks, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM docs) SELECT array_to_string(toks[greatest(pos - 5, 1):pos - 1], ' ') AS \"LeftContext\", 'of the' AS \"Node\", array_to_string(toks[pos + 2:pos + 6], ' ') AS \"RightContext\", doc_id AS \"DocId\", pos AS \"Position\" FROM t WHERE w = 'of' AND toks[pos + 1] = 'the'")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kwic.kwic(corpus(spark, sf_dir), "of the", 5, None).lines


@query(f"WITH {S.docs_cte()}, t AS (SELECT doc_id, unnest(toks) AS w FROM docs), x AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS d FROM t WHERE w = 'the') SELECT n AS total_occurrences, d AS documents_with_node, least(n, 1000) AS lines_generated, n > 1000 AS truncated, 1::BIGINT AS ngram_length, 50::BIGINT AS context_size FROM x")
def concordance_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kwic.kwic(corpus(spark, sf_dir), "the").statistics


_AROUND = "SELECT doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM docs"


@query(f"WITH {S.docs_cte()}, t AS ({_AROUND}) SELECT DISTINCT x.doc_id, x.w AS word FROM t o JOIN t x ON o.doc_id = x.doc_id AND o.w = 'the' AND x.pos BETWEEN o.pos - 2 AND o.pos - 1")
def prior_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).with_tokens("t").select("doc_id", F.explode(T.prior_words(F.col("t"), "the", 2)).alias("word"))


@query(f"WITH {S.docs_cte()}, t AS ({_AROUND}) SELECT DISTINCT x.doc_id, x.w AS word FROM t o JOIN t x ON o.doc_id = x.doc_id AND o.w = 'the' AND x.pos BETWEEN o.pos + 1 AND o.pos + 2")
def following_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).with_tokens("t").select("doc_id", F.explode(T.following_words(F.col("t"), "the", 2)).alias("word"))


@query(f"WITH {S.docs_cte(keep=', text')} SELECT doc_id, len(list_filter(toks, lambda x: x = 'the'))::INT AS n_the, ((length(text) - length(replace(text, 'th', ''))) // 2)::INT AS n_th FROM docs")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return c.with_tokens("t").select("doc_id", T.count_word(F.col("t"), "the").alias("n_the"), T.count_substrings(F.col("text"), "th").alias("n_th"))


@query(f"WITH {S.docs_cte()} SELECT doc_id FROM docs WHERE len(toks) BETWEEN 50 AND 500")
def doc_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).filter_length(50, 500).df.select("doc_id")


@query(S.token_table() + ' SELECT w AS "Token", f AS "Frequency", df AS "DocFrequency" FROM freq WHERE f BETWEEN 2 AND 100')
def vocab_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.filter_vocabulary(corpus(spark, sf_dir), 2, 100)


@query(r"SELECT doc_id, strip_accents(lower(regexp_replace(regexp_replace(text, '\p{P}+', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM documents")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.normalised(F.col("text"), TextNorm(strip_accents=True)).alias("text"))


_SIG = ["ChiSquare", "LLR", "Tscore", "Zscore"]


@query(S.contingency(["the"], 5, 5) + f", s0 AS ({S.score(_SIG)}) SELECT *, ((\"ChiSquare\" > 10.83)::INT + (\"LLR\" > 10.83)::INT + (abs(\"Tscore\") > 3.291)::INT + (abs(\"Zscore\") > 3.291)::INT) AS \"Votes\", ((\"ChiSquare\" > 10.83)::INT + (\"LLR\" > 10.83)::INT + (abs(\"Tscore\") > 3.291)::INT + (abs(\"Zscore\") > 3.291)::INT) >= 3 AS \"Significant\" FROM s0")
def significance_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.significance(tidied(corpus(spark, sf_dir).contingency("the", 5, 5).score(_SIG)))


@query(S.contingency(NODES, 5, 5) + f", s AS (SELECT \"Node\", \"Collocate\", {S.METRIC_SQL['LogDice']} AS p FROM dbl), q AS (SELECT * FROM s WHERE p > 0), z AS (SELECT \"Node\", count(*) AS n, sqrt(sum(p * p)) AS l FROM q GROUP BY 1), j AS (SELECT x.\"Node\" AS n1, y.\"Node\" AS n2, count(*) AS k, sum(x.p * y.p) AS dot FROM q x JOIN q y ON x.\"Collocate\" = y.\"Collocate\" AND x.\"Node\" < y.\"Node\" GROUP BY ALL), w AS (SELECT n1, n2, k, k::DOUBLE / (a.n + b.n - k) AS ja, dot / (a.l * b.l) AS co FROM j JOIN z a ON a.\"Node\" = n1 JOIN z b ON b.\"Node\" = n2) SELECT n1 AS \"Node1\", n2 AS \"Node2\", k AS \"Shared\", {S.tidy('ja')} AS \"Jaccard\", {S.tidy('co')} AS \"Cosine\" FROM w")
def shared_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidied(recipes.shared_contexts(corpus(spark, sf_dir), NODES, "LogDice"))
