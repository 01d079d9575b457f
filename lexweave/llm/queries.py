"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audio, decontam, htmltext, langid, license, mixing, simhash, substring, toxicity, urlfilter
from ._spark import table


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.voiced_features(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.default_rules(spark))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flag_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_html(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_audio_features, op2_simhash_near_dedup, op3_language_id, op4_url_filters, op5_source_mixing, op6_substring_dedup, op7_license_scan, op8_benchmark_decontamination, op9_toxicity, op10_html_text)}

_RULES = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in urlfilter.RULES)


def _split(column: str) -> str:
    bare = rf"regexp_replace(regexp_replace(trim({column}), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '')"
    authority = rf"regexp_extract({bare}, '^([^/?]*)', 1)"
    host = rf"regexp_replace(lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[0-9]*$', '')), '\.+$', '')"
    return f"{host} AS host, substr({bare}, length({authority}) + 1) AS rest"


_REVERSED = "array_to_string(list_reverse(string_split(host, '.')), '.') || '.'"

ORACLE_SQL = {
    "op4_url_filters": f"""
WITH r AS (SELECT rule_id, action, {_split("pattern")} FROM (VALUES {_RULES}) AS v(rule_id, pattern, action)),
rules AS (SELECT rule_id, action, {_REVERSED} || rest AS prefix FROM r WHERE host <> ''),
p AS (SELECT page_id, url, {_split("url")} FROM pages),
keys AS (SELECT page_id, url, CASE WHEN host <> '' THEN {_REVERSED} || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS key FROM p),
hit AS (SELECT k.page_id, k.url, k.key, x.rule_id, x.action,
  row_number() OVER (PARTITION BY k.page_id, k.url ORDER BY length(x.prefix) DESC NULLS LAST, CASE WHEN x.action = 'block' THEN 0 ELSE 1 END, x.rule_id) AS n
  FROM keys k LEFT JOIN rules x ON starts_with(k.key, x.prefix))
SELECT page_id, url, CAST(rule_id AS BIGINT) AS rule_id, CASE WHEN key IS NULL THEN 'invalid' ELSE coalesce(action, 'allow') END AS action
FROM hit WHERE n = 1
""",
    "op3_language_id": f"""
WITH t AS (SELECT doc_id, lang, row_number() OVER () AS rid, ' ' || trim(regexp_replace(lower(text), '\\PL+', ' ', 'g')) || ' ' AS s FROM documents),
c AS (SELECT rid, doc_id, lang, string_split(s, '') AS ch FROM t WHERE length(s) > 2),
g AS (
  SELECT rid, ch[i] AS g FROM (SELECT rid, ch, unnest(range(1, len(ch) + 1)) AS i FROM c) WHERE ch[i] <> ' '
  UNION ALL SELECT rid, ch[i] || ch[i + 1] FROM (SELECT rid, ch, unnest(range(1, len(ch))) AS i FROM c)
  UNION ALL SELECT rid, ch[i] || ch[i + 1] || ch[i + 2] FROM (SELECT rid, ch, unnest(range(1, len(ch) - 1)) AS i FROM c) WHERE ch[i + 1] <> ' '),
n AS (SELECT rid, g, count(*) AS n FROM g GROUP BY ALL),
pick AS (SELECT rid, lang FROM (SELECT rid, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM t WHERE lang IS NOT NULL) WHERE k <= {langid.PER_LANGUAGE}),
prof AS (SELECT lang, g, r FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS r FROM n JOIN pick USING (rid) GROUP BY lang, g) WHERE r < {langid.SIZE}),
own AS (SELECT rid, g, r FROM (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, g) - 1 AS r FROM n) WHERE r < {langid.SIZE}),
size AS (SELECT rid, count(*) AS m FROM own GROUP BY rid),
d AS (SELECT rid, lang, sum({langid.SIZE} - abs(own.r - prof.r)) AS near FROM own JOIN prof USING (g) GROUP BY rid, lang),
e AS (SELECT s.rid, l.lang, {langid.SIZE} * m - coalesce(near, 0) AS dist, m FROM size s CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN d ON d.rid = s.rid AND d.lang = l.lang),
b AS (SELECT rid, lang, CAST(dist AS DOUBLE) / ({langid.SIZE} * m) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, lang) AS k FROM e) WHERE k = 1)
SELECT t.doc_id, b.lang AS pred_lang, coalesce(b.distance, 1.0) AS distance, b.lang IS NULL OR b.distance > {langid.MAX_DISTANCE} AS rejected FROM t LEFT JOIN b USING (rid)
""",
}
