from datetime import datetime

from lexweave.corpus import Corpus
from lexweave.streaming import incremental as inc


def test_stream_equals_batch(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    texts = [f"test document {i} with some words and test {i % 2}" for i in range(6)]
    for i, t in enumerate(texts):
        (d / f"doc_{i}.txt").write_text(t, encoding="utf-8")
    seen = []
    stream = inc.stream_files(spark, str(d), per_batch=2)
    q = inc.start_stream(stream, ["test"], ["Dice", "LLR"], str(tmp_path / "check"), lambda df, i: seen.append({(r["Collocate"], r["Frequency"], round(r["LLR"], 6)) for r in df.collect()}), 3, 1)
    q.awaitTermination(120)
    want = {(r["Collocate"], r["Frequency"], round(r["LLR"], 6)) for r in Corpus.from_texts(spark, texts).contingency("test", 3, 1).score(["Dice", "LLR"]).collect()}
    assert len(seen) >= 3 and seen[-1] == want
    assert inc.stream_corpus_analysis(spark, f"{d}/*.txt", "test", "Dice", 3, 1).df.count() == len(want)


def test_windows_of_time(spark):
    rows = [(1, "a b", datetime(2024, 1, 1, 1)), (2, "a b", datetime(2024, 1, 1, 5)), (3, "a b", datetime(2024, 1, 2, 1)), (4, None, None)]
    got = inc.windowed_counts(spark.createDataFrame(rows, "doc_id long, text string, ts timestamp"), ["a"]).collect()
    assert sorted((r["TimeWindow"]["start"].day, r["a"]) for r in got) == [(1, 2), (2, 1)]
