import random

import corpus_pipeline
from lexweave.llm import mixing, substring

from .common import documents, rows_of_all_kinds, text, with_clashes
from .test_substring import brute


def test_pipeline_against_a_plain_version(spark, tmp_path):
    rng = random.Random(1)
    shared = text(rng, 70)
    item = text(rng, 30)
    rows = [(i, text(rng, 150), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[1][1] + " more", "en", "s1")]  # copies
    rows += [(110 + i, f"{text(rng, 90)} {shared} {text(rng, 40)}", "en", "s2") for i in range(3)]  # a shared passage
    rows += [(120, f"{text(rng, 60)} {item} {text(rng, 60)}", "en", "s0"), (121, "漢字 " * 50, "en", "s1"), (122, None, "en", "s1"), (123, "", "en", "s2")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = {i: t for i, t, _, _ in rows if i not in (121, 122, 123)}  # 1: no language
    for gone in (100, 101):  # 2: copies
        del docs[gone]
    for d, s, e in sorted(brute(list(docs.items()), substring.BLOCK, substring.MIN_WORDS), reverse=True):  # 3: all but the first of the passages
        w = docs[d].split()
        docs[d] = " ".join(w[:s] + w[e:])
    del docs[120]  # 4: holds the item
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r["text"])
    assert {d: t[0] for d, t in found.items()} == {d: docs[d] for d in found}
    rate = mixing.copies(documents(spark, [(d, t, "en", dict((i, s) for i, _, _, s in rows)[d]) for d, t in docs.items()]))
    want = {r["doc_id"]: r["copies"] for r in rate.collect()}  # 5: copies follow the sizes
    assert {d: len(t) for d, t in found.items()} == {d: n for d, n in want.items() if n}
    assert set(want) == set(docs)


def test_stages_keep_the_columns(spark, tmp_path):
    rng = random.Random(2)
    docs = documents(spark, [(i, text(rng, 60), "en", "s") for i in range(20)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(rng, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 20
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_with_rows_of_all_kinds(spark, tmp_path):
    """Every stage answers nulls, empty, very long and repeated texts, repeated ids and clashing columns, and keeps the clean rows."""
    rng = random.Random(3)
    docs = with_clashes(documents(spark, rows_of_all_kinds(rng) + [(100 + i, text(rng, 60), "en", "a") for i in range(20)]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(rng, 30)), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns if k < 4 else set(out.columns) == set(docs.columns)
        assert {r["doc_id"] for r in out.select("doc_id").collect()} >= ({100 + i for i in range(20)} if k < 4 else set())
        docs = out if k != 4 else docs
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
