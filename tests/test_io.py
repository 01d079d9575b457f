import codecs
import json

import pytest

from lexweave.corpus import Corpus
from lexweave.operators import kwic, network
from lexweave.sources import readers, writers


def test_decoding():
    for text, raw in (("é", codecs.BOM_UTF8 + "é".encode()), ("aé", codecs.BOM_UTF16_LE + "aé".encode("utf-16-le")), ("aé", codecs.BOM_UTF16_BE + "aé".encode("utf-16-be")), ("é", "é".encode()), ("Καλημέρα", "Καλημέρα".encode("windows-1253")), ("", b"")):
        assert readers.decode_bytes(raw) == text


def test_read_corpus(spark, tmp_path):
    d = tmp_path / "texts"
    d.mkdir()
    (d / "a.txt").write_text("one two three", encoding="utf-8")
    (d / "b.txt").write_bytes("καλημέρα κόσμε".encode("windows-1253"))
    (d / "c.md").write_text("not this", encoding="utf-8")
    (d / "sub").mkdir()
    (d / "sub" / "d.txt").write_text("deeper text", encoding="utf-8")
    got = {r["text"] for r in readers.read_corpus(spark, str(d), min_doc_length=1).df.collect()}
    assert got == {"one two three", "καλημέρα κόσμε"}
    assert readers.from_dir(spark, str(d)).df.count() == 3
    assert readers.from_file(spark, str(d / "a.txt")).df.first()["text"] == "one two three"
    assert readers.from_glob(spark, f"{d}/*.txt").df.count() == 2

    (tmp_path / "x.csv").write_text('text,year\n"a b, c",2020\n"one",2021\n', encoding="utf-8")
    c = readers.read_corpus(spark, str(tmp_path / "x.csv"), min_doc_length=2)
    assert [(r["text"], r["year"]) for r in c.df.collect()] == [("a b, c", 2020)]
    (tmp_path / "x.json").write_text(json.dumps([{"text": "a b", "k": 1}, {"text": ""}, {"k": 3}]), encoding="utf-8")
    assert readers.read_corpus(spark, str(tmp_path / "x.json"), min_doc_length=0).df.count() == 1
    with pytest.raises(ValueError):
        readers.read_corpus(spark, str(tmp_path / "x.csv"), text_column="nothing")
    with pytest.raises(ValueError):
        readers.read_corpus(spark, str(tmp_path / "x.doc"))


def test_metadata_round_trip(spark, tmp_path):
    r = Corpus.from_texts(spark, ['a "b", c b']).analyze_node("b", "Dice", 5, 1)
    for f in ("csv", "json"):
        path = writers.export_with_metadata(r, str(tmp_path / f"out.{f}"), f)
        back = readers.load_with_metadata(spark, path, f)
        assert back.meta == r.meta
        assert {x["Collocate"]: x["Dice"] for x in back.df.collect()} == {x["Collocate"]: x["Dice"] for x in r.df.collect()}
    with pytest.raises(ValueError):
        writers.export_with_metadata(r, str(tmp_path / "out"), "xml")
    writers.write_with_metadata(r, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == r.df.count()


def test_exports(spark, tmp_path):
    c = Corpus.from_texts(spark, ["a b c a", "b a"])
    for f, name in (("csv", "k.csv"), ("tsv", "k.tsv"), ("xlsx", "k.xlsx")):
        path = writers.export_kwic(kwic.kwic(c, "a"), str(tmp_path / "deep" / name), f)
        assert open(path, "rb").read()
    g = network.colloc_graph(c, ["a"], "Dice", depth=1, minfreq=1)
    nodes, edges = writers.gephi_graph(g, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert open(nodes, encoding="utf-8").readline().startswith("Id,Label,Layer") and len(open(edges, encoding="utf-8").readlines()) > 1
    (tmp_path / "nodes.txt").write_text("a\n\n  b  \nc\n", encoding="utf-8")
    whole = writers.batch_process_corpus(c, str(tmp_path / "nodes.txt"), str(tmp_path / "batches"), ["Dice"], 5, 1, batch_size=2)
    assert {r["Node"] for r in whole.collect()} == {"a", "b", "c"} and whole.select("batch").distinct().count() == 2
    assert (tmp_path / "batches" / "all_batches_combined.csv").exists()
