import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import mixing as M

from .common import documents, with_clashes


def test_fights_keep_the_sum_and_the_expectation():
    rng = np.random.default_rng(1)
    for a, b in ((0.2, 0.3), (0.6, 0.7), (0.5, 0.5)):
        got = np.array([M.fight(a, b, u) for u in rng.random(20000)])
        assert np.allclose(got.sum(axis=1), a + b) and np.allclose(got.mean(axis=0), [a, b], atol=0.02)
        assert (((got == 0) | (got == 1)).any(axis=1)).all()


def test_pivot_leaves_at_most_one():
    rng = np.random.default_rng(2)
    for n in range(30):
        m = rng.random(n)
        total = m.sum()
        left = M.pivot(m, rng.random(n))
        loose = [i for i, x in enumerate(m) if 1e-9 < x < 1 - 1e-9]
        assert m.sum() == pytest.approx(total, abs=1e-6) and loose == ([left] if left >= 0 else [])


def rows(n=900, seed=3):
    rng = random.Random(seed)
    return [(i, "x" * rng.randint(1, 50), "en", rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(n)]


def rates(data, alpha=0.7):
    held = {}
    for _, t, _, s in data:
        held[s] = held.get(s, 0) + len(t or "")
    w = {s: x**alpha for s, x in held.items()}
    return {s: w[s] / sum(w.values()) * sum(held.values()) / held[s] for s in held}


def test_copies_against_the_rates(spark):
    data = rows()
    got = M.copies(with_clashes(documents(spark, data)), parts=5, fan_in=2).collect()
    want = rates(data)
    assert sorted(r["doc_id"] for r in got) == [d[0] for d in data]
    for s, rate in want.items():
        mine = [r["copies"] for r in got if r["source"] == s]
        assert set(mine) <= {int(rate), int(rate) + 1} and abs(sum(mine) - rate * len(mine)) < 2
    again = M.copies(documents(spark, data), parts=5, fan_in=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)  # a task run again decides the same


def test_each_document_has_its_probability(spark):
    data, total = rows(60, 4), np.zeros(60)
    for seed in range(12):
        for r in M.copies(documents(spark, data), parts=3, fan_in=2, seed=seed * 7).collect():
            total[r["doc_id"]] += r["copies"]
    want = rates(data)
    assert abs(total / 12 - [want[s] for _, _, _, s in data]).mean() < 0.2


def test_targets_and_odd_rows(spark):
    docs = documents(spark, [(1, "aaaa", "en", "x"), (1, "aa", "en", "x"), (2, None, "en", "x"), (3, "bb", "en", "y"), (4, "", "en", "z"), (None, "cc", "en", "x"), (5, "dddd", "en", "w")])
    targets = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "source string, weight double")
    got = {r["doc_id"]: r["copies"] for r in M.copies(docs, targets=targets, parts=2).collect()}
    assert got[5] == 0 and got[4] == 1 and set(got) == {1, 2, 3, 4, 5, None}
    mixed = M.mix_documents(docs, targets=targets, parts=2)
    assert mixed.columns == [*docs.columns, "copy_no"]
    assert M.copies(docs.limit(0)).count() == 0 and M.mix_documents(docs.limit(0)).count() == 0


def plain(data, rate, parts, fan_in, seed, part_of):
    """The same rounding, document by document."""
    def spin(rows, s):
        """(doc, mass) in order: the decided ones, and what is left."""
        done, held = {}, None
        for d, m in rows:
            if m < 1e-9 or m > 1 - 1e-9:
                done[d] = round(m)
            elif held is None:
                held = (d, m)
            else:
                x, y = M.fight(held[1], m, float(M.uniform(np.array([d]), s)[0]))
                pair = [(held[0], x), (d, y)]
                held = next(((d, m) for d, m in pair if 1e-9 < m < 1 - 1e-9), None)
                done |= {d: round(m) for d, m in pair if held is None or d != held[0]}
        return done, held

    done, left = {}, {}
    for p in range(parts):
        for s in {s for _, _, _, s in data}:
            mine = sorted((d, rate[s] - int(rate[s])) for d, _, _, x in data if x == s and part_of[d] == p)
            got, held = spin(mine, seed)
            done |= got
            if held:
                left.setdefault(p, []).append((s, *held))
    groups, depth = parts, 0
    while True:
        last, depth = groups == 1, depth + 1
        groups, up = -(-groups // fan_in), {}
        for p, rows in left.items():
            up.setdefault(p // fan_in, []).extend(rows)
        left = {}
        for p, rows in up.items():
            rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
            runs = [[r for r in rows if r[0] == s] for s in dict.fromkeys(r[0] for r in rows)] if not last else [rows]
            for run in runs:
                got, held = spin([r[1:] for r in run], seed + depth)
                done |= got
                if held:
                    left.setdefault(p, []).append((next(r[0] for r in run if r[1] == held[0]), *held))
        if last:
            break
    for rows in left.values():
        done |= {d: int(M.uniform(np.array([d]), seed - 1)[0] < m) for _, d, m in rows}
    return {d: done[d] + int(rate[s]) for d, _, _, s in data}


def test_copies_against_a_plain_pivotal_run(spark):
    data = rows(300, 8)
    docs = documents(spark, data)
    part_of = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(7)).alias("p")).collect()}
    got = {r["doc_id"]: r["copies"] for r in M.copies(docs, parts=7, fan_in=3).collect()}
    assert got == plain(data, rates(data), 7, 3, M.SEED, part_of)


def test_ids_of_another_type_and_columns_of_any_name(spark):
    docs = documents(spark, rows(60, 9)).withColumns({"doc_id": F.concat(F.lit("d"), "doc_id"), "__id": F.lit("x"), "__n": F.lit("y")})
    mixed = M.mix_documents(docs)
    again = M.mix_documents(mixed.withColumn("doc_id", F.concat("doc_id", F.lit("-"), "copy_no")))
    assert mixed.columns == [*docs.columns, "copy_no"] == again.columns and again.count() > 0
    n = {r["doc_id"]: r["copies"] for r in M.copies(docs).collect()}
    assert set(n) == {f"d{i}" for i in range(60)} and mixed.count() == sum(n.values())


def test_mixed_rows_are_the_copies(spark):
    docs = documents(spark, rows(200, 6))
    n = {r["doc_id"]: r["copies"] for r in M.copies(docs).collect()}
    got = {}
    for r in M.mix_documents(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["copy_no"])
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(c)) for k, c in n.items() if c}
