"""URL filters as a sort-merge range join.

A URL becomes a canonical key: host labels reversed, each followed by a dot,
then path and query (``https://a.b.org/x?y`` -> ``org.b.a./x?y``).  A rule for
a domain covers the keys that begin with its reversed labels (the host itself
and its subdomains); a rule with a path covers keys of that one host whose path
begins so.  Each rule is thus an interval of keys, and two intervals are nested
or disjoint.  Keys and interval starts are range-partitioned and sorted; one
sweep keeps the stack of the rules that hold the present key, and its top is
the most specific.  A rule whose interval reaches over several partitions is
sent to each of them.

Defined results: the longest matching prefix wins, among equal prefixes
``block`` before ``allow`` and then the smallest rule_id.  A URL that is null or
has no host gets action ``invalid`` and no rule; a URL that no rule holds gets
``allow`` and no rule.  Rules with a null or empty pattern are ignored.
Repeated rows are each answered.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import partitions

#: rule_id, pattern, action
RULES = [
    (1, "spam-farm.example.org", "block"),
    (2, "example.net/ads/", "block"),
    (3, "m.ththth.example.net", "block"),
    (4, "m.ththth.example.net/en/2", "allow"),
    (5, "example.com", "allow"),
    (6, "blog.tiontion.example.com", "block"),
    (7, "blog.tiontion.example.com/en/8", "allow"),
    (8, "spam-farm.example.org/en/7", "block"),
    (9, "ththre.example.com/fr/", "block"),
    (10, "ththre.example.com/fr/82", "allow"),
    (11, "blog.ththan.example.net/en/", "block"),
    (12, "test", "block"),
]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id long, pattern string, action string")


def _host_path(url: Column) -> tuple[Column, Column]:
    u = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"#.*$", "")
    authority = F.regexp_extract(u, r"^([^/?]*)", 1)
    rest = F.substr(u, F.length(authority) + 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(host, r"\.+$", "")
    return host, rest


def _reversed(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def url_key(url: Column) -> Column:
    """Canonical key; null for a URL without host."""
    host, rest = _host_path(url)
    path = F.when(F.substr(rest, F.lit(1), F.lit(1)) == "/", rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.length(host) > 0, F.concat(_reversed(host), path))


def rule_prefix(pattern: Column) -> Column:
    """Prefix that the rule's keys share; null for an empty pattern."""
    host, rest = _host_path(pattern)
    return F.when(F.length(host) > 0, F.concat(_reversed(host), rest))


def _bounds(keys: DataFrame, parts: int) -> list[str]:
    """At most ``parts - 1`` keys that cut the table into about equal ranges (what a range partitioner samples)."""
    if parts <= 1:
        return []
    per = 20
    n = keys.count()
    if not n:
        return []
    share = min(1.0, 3.0 * per * parts / n)
    got = sorted(r[0] for r in keys.sample(share, seed=7).collect()) if share < 1 else sorted(r[0] for r in keys.collect())
    return sorted({got[len(got) * i // parts] for i in range(1, parts)}) if got else []


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", parts: int | None = None) -> DataFrame:
    """``page_id, url, rule_id, action`` for each row of ``pages``."""
    spark = pages.sparkSession
    parts = parts or partitions(spark)
    ids = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), url_key(F.col(url)).alias("key"))
    # what has no key takes no part in the sweep, so it meets in no range
    invalid = rows.filter("key is null").select(F.col("id").alias(key), "url", F.lit(None).cast("long").alias("rule_id"), F.lit("invalid").alias("action"))
    rows = rows.filter("key is not null")
    cuts = [b.encode() for b in _bounds(rows.select("key"), parts)]

    @F.pandas_udf("int")
    def range_of(k):
        return k.map(lambda x: bisect_right(cuts, x.encode())).astype("int32")

    @F.pandas_udf("array<int>")
    def ranges_of(k):  # of the interval of a prefix; it ends before the prefix followed by the highest byte
        return k.map(lambda x: list(range(bisect_right(cuts, x.encode()), bisect_right(cuts, x.encode() + b"\xff") + 1)))

    prefixes = rules.select(rule_prefix(F.col("pattern")).alias("key"), F.col("rule_id").cast("long").alias("rule_id"), F.col("action")).filter("key is not null")
    prefixes = prefixes.groupBy("key").agg(F.min(F.struct((F.col("action") != "block").alias("o"), "rule_id", "action")).alias("r"))  # ties
    starts = prefixes.select(F.explode(ranges_of("key")).alias("part"), F.lit(0).alias("kind"), "key", F.lit(None).cast(ids).alias("id"), F.lit(None).cast("string").alias("url"), F.col("r.rule_id").alias("rule_id"), F.col("r.action").alias("action"))
    points = rows.select(range_of("key").alias("part"), F.lit(1).alias("kind"), "key", "id", "url", F.lit(None).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("action"))
    both = starts.unionByName(points).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, int, str]] = []
        for b in batches:
            kinds, keys = b.column("kind").to_pylist(), b.column("key").to_pylist()
            rule_ids, actions = b.column("rule_id").to_pylist(), b.column("action").to_pylist()
            take, found, verdict = [], [], []
            for i, (kind, k) in enumerate(zip(kinds, keys, strict=True)):
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((k, rule_ids[i], actions[i]))
                else:
                    take.append(i)
                    found.append(stack[-1][1] if stack else None)
                    verdict.append(stack[-1][2] if stack else "allow")
            out = b.take(pa.array(np.array(take, np.int64)))
            yield pa.RecordBatch.from_arrays([out.column("id"), out.column("url"), pa.array(found, pa.int64()), pa.array(verdict, pa.string())], [key, "url", "rule_id", "action"])

    return both.mapInArrow(sweep, f"`{key}` {ids}, url string, rule_id long, action string").unionByName(invalid)
