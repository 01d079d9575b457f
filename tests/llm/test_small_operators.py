import random
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexweave.llm import audio, htmltext, langid, license, toxicity, urlfilter
from lexweave.llm import queries as Q
from lexweave.llm._text import Words, find_words, stable_hash

from .common import documents, text, with_clashes


# language ID
def profile(t, size):
    t = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
    t = " " + " ".join(t.split()) + " "
    grams = Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n] != " " and not (n == 3 and t[i + 1] == " ") and not (n == 2 and t[i : i + 2].strip() == ""))
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_language_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.randint(5, 80), la), la, "s") for i, la in enumerate(["en", "fr", "de"] * 20)]
    docs = with_clashes(documents(spark, [*rows, (100, None, "en", "s"), (101, "", "fr", "s"), (102, "123 !", "de", None), (None, "the", None, None), (103, text(rng, 60000), "en", "s"), (104, "漢字漢字 漢字", None, "s")]))
    learnt = langid.train_profiles(docs)
    got = {r["doc_id"]: r for r in langid.identify_language(docs, learnt).collect()}
    unpack = {la: ["".join(chr(int(k) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(k) >> s & 0x1FFFFF) for k in p] for la, p in learnt.items()}
    for i, t, la, _ in rows[:30]:
        mine = profile(t, langid.SIZE)
        dist = {x: sum(abs(r - p.index(g)) if g in p else langid.SIZE for r, g in enumerate(mine)) for x, p in unpack.items()}
        best = min(sorted(dist), key=dist.get)
        assert got[i]["pred_lang"] == best and got[i]["distance"] == pytest.approx(dist[best] / (langid.SIZE * len(mine)))
    assert np.mean([got[i]["pred_lang"] == la for i, _, la, _ in rows]) > 0.95
    assert all(got[i]["pred_lang"] is None and got[i]["rejected"] for i in (100, 101, 102)) and got[104]["rejected"]
    kept = langid.filter_language(docs, learnt)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["rejected"]}
    assert langid.identify_language(docs.limit(0)).count() == 0


# toxicity
def toxic_rows():
    rng = random.Random(2)
    bad = ["vilewordone", "nastyphrase", "scumbagtwo", "hatefulthree"]
    rows, labels = [], []
    for i in range(600):
        w = text(rng, rng.randint(20, 120)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s"))
        if i % 10 < 7:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_rows()
    rng = random.Random(9)
    long = text(rng, 30000) + " vilewordone nastyphrase scumbagtwo vilewordone hatefulthree nastyphrase " + text(rng, 30000)
    docs = with_clashes(documents(spark, [*rows, (900, None, None, None), (901, "", "en", "s"), (902, "?!", "en", "s"), (None, "text without id", "en", "s"), (903, long, "en", "s"), (0, rows[0][1], "en", "s")]))
    lab = spark.createDataFrame([*labels, (0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    flagged = [r["doc_id"] for r in toxicity.flag_toxic(docs, lab).collect()]
    held_out = {i for i, *_ in rows} - {i for i, _ in labels}
    want = {i for i in range(0, 600, 6)} & held_out
    hit = set(flagged)
    assert len(want) == 20 and len(hit & want) >= 0.95 * len(want) and len(hit & held_out - want) <= 3 and 903 in hit and not hit & {900, 901, 902}
    assert flagged.count(0) == 2
    assert toxicity.flag_toxic(docs, lab.filter("toxic = 0")).count() == 0 and toxicity.flag_toxic(docs.limit(0), lab).count() == 0


def test_windows_and_features_against_plain_ones():
    rng = random.Random(4)
    texts = [text(rng, n) for n in (3, 8, 9, 13, 40)] + ["", None]
    w = find_words(pa.array(texts), lower=True)
    row, feat, owner = toxicity.features(pa.array(texts), 10, 8)
    got = {}
    for r, f in zip(row.tolist(), feat.tolist(), strict=True):
        got.setdefault(r, set()).add(f)
    parts = [(d, t.split()[i : i + 8]) for d, t in enumerate(texts) if t for n in [len(t.split())] for i in [*range(0, n, 8), *(range(4, n, 8) if n > 8 else [])]]
    assert owner.tolist() == [d for d, _ in parts]
    for r, (_, ws) in enumerate(parts):
        count = Counter()
        for x in ws:
            raw = x.encode()
            count.update([(stable_hash(x)) >> 54] + [find_words(pa.array([raw[:n].decode("utf-8", "replace")])) and int(Words(np.frombuffer(raw[:n], np.uint8), np.array([0]), np.array([n]), np.array([0, 1])).hashes(n)[0]) >> 54 for n in toxicity.PREFIXES if len(raw) > n])
        assert got[r] == {f * 3 + k for f, c in count.items() for k, least in enumerate((1, 2, 4)) if c >= least}
    assert w.n_docs == len(texts)
    some = toxicity.evenly(row, feat, owner, 3)
    assert np.bincount(some[2], minlength=5).tolist() == [1, 1, 3, 3, 3] and set(some[0].tolist()) <= set(range(len(some[2])))


def test_toxicity_with_other_ids_and_labels(spark):
    rows, labels = toxic_rows()
    docs = with_clashes(documents(spark, rows)).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    lab = spark.createDataFrame([(f"d{i}", t) for i, t in labels] + [("d1", 7), ("nobody", 1)], "doc_id string, toxic int")
    got = {r["doc_id"] for r in toxicity.flag_toxic(docs, lab).collect()}
    assert len(got & {f"d{i}" for i in range(0, 600, 6)}) >= 95 and len(got) <= 105
    assert toxicity.flag_toxic(docs, lab.filter("toxic > 1")).count() == 0


def test_risk_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    for shift in (0.0, -4.0):  # the second has a negative part below zero
        z, pos = rng.standard_normal(30) + shift, np.arange(30) < 10
        z[pos] += 6
        risk, g = toxicity.risk_gradient(z, pos, 0.4)
        part = np.logaddexp(0, z[~pos]).mean() - 0.4 * np.logaddexp(0, z[pos]).mean()
        for i in range(30):
            up, down = z.copy(), z.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            if part >= 0:
                d = (toxicity.risk_gradient(up, pos, 0.4)[0] - toxicity.risk_gradient(down, pos, 0.4)[0]) / 2e-5
            else:
                f = lambda x: -(np.logaddexp(0, x[~pos]).mean() - 0.4 * np.logaddexp(0, x[pos]).mean())
                d = (f(up) - f(down)) / 2e-5
            assert g[i] == pytest.approx(d, abs=1e-5)
        assert risk >= 0


def test_toxicity_counts_trains_and_cuts_on_everything(spark):
    """Counts, gradients and the threshold, against plain ones of all windows of all labelled documents; none was so before: 1500 toxic documents, 64 windows."""
    rng = random.Random(12)
    rows = [(i, text(rng, rng.randint(5, 60)) + " vileword" * (i % 8 == 0) * rng.randint(1, 5), "en", "s") for i in range(400)]
    rows += [(1000 + i, f"vileword {i}", "en", "s") for i in range(1700)] + [(3000, "vileword " * 2000, "en", "s"), (0, "another vileword text", "en", "s")]
    lab = [(i, int(i % 8 == 0)) for i in range(0, 300)] + [(1000 + i, 1) for i in range(1700)] + [(3000, 1), (301, None)]
    docs, labels = documents(spark, rows), spark.createDataFrame(lab, "doc_id int, toxic int")
    known, share = toxicity.known_documents(docs, labels)
    kinds = {r["doc_id"]: r["kind"] for r in known.collect()}
    toxic = {i for i, t in lab if t == 1}
    assert {i for i, k in kinds.items() if k == toxicity.POSITIVE} == toxic and len(kinds) == len(lab) and share == pytest.approx(len(toxic) / (len(lab) - 1))
    texts = [t for i, t, *_ in rows if i in toxic]
    row, feat, owner = toxicity.features(pa.array(texts), 12, 20)
    p_count, n_p = toxicity._frequencies(toxicity._texts_of(docs, known.filter("kind = 0").select("doc_id"), "text"), 12, 20)
    assert len(texts) > 1700 and n_p == len(owner) and (p_count == np.bincount(feat, minlength=3 << 12)).all()

    names = np.flatnonzero(p_count)
    table = toxicity.window_table(docs, known, "text", names, 12, 20)
    mine = [(kinds[i], t) for i, t, *_ in rows if i in kinds]
    row, feat, owner = toxicity.features(pa.array([t for _, t in mine]), 12, 20)
    hit = np.isin(feat, names)
    row, feat, kind = row[hit], np.searchsorted(names, feat[hit]), np.array([k for k, _ in mine])[owner]
    w, b = np.random.default_rng(1).random((toxicity.FOLDS + 1, len(names))) / 20, np.linspace(-1.5, -0.5, toxicity.FOLDS + 1)
    total = sum(toxicity.sums(*toxicity.unpack(x), w, b) for x in table.toArrow().to_batches()) / toxicity.UNIT
    n_u = np.array([np.sum((kind != 0) & (kind != toxicity.CLEAN + j)) for j in range(len(w))])
    got, got_b = toxicity.gradient(total, p_count[names], share, n_p, n_u)
    for j in range(len(w)):
        z = np.bincount(row, w[j][feat], minlength=len(kind)) + b[j]
        pos, rest = kind == 0, (kind != 0) & (kind != toxicity.CLEAN + j)
        part = np.logaddexp(0, z[rest]).mean() - share * np.logaddexp(0, z[pos]).mean()
        s, q = 1 / (1 + np.exp(-z)), toxicity.pull(part)
        g = np.where(pos, share / n_p * (s - 1 - q * s), 0) + np.where(rest, q * s / n_u[j], 0)
        assert np.allclose(got[j], np.bincount(feat, g[row], minlength=len(names)), atol=1e-4) and got_b[j] == pytest.approx(g.sum(), abs=1e-4)

    values = np.concatenate([np.random.default_rng(2).standard_normal(5000), [0.0, -0.0, -np.inf, 1e300, -1e-300], np.full(40, 2.5)])
    keys = spark.createDataFrame([(int(k),) for k in toxicity.ordered(values)], "key long")
    for most in (0.002, 0.3):
        assert toxicity.cutoff(keys, most) == np.quantile(values, 1 - most, method="higher")
    assert toxicity.cutoff(keys.limit(0), 0.1) == 0 and toxicity.cutoff(keys, 0.9) == 0


# URL filters
def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.org", "x.a.org", "y.x.a.org", "b.org", "ba.org", "org"]
    urls = [(i, rng.choice(["http://", "https://", ""]) + rng.choice(hosts) + rng.choice(["", "/", "/p", "/p/q", "/pq?r=1", "?z", ":80/p", "#f"])) for i in range(300)]
    rules = [(i, rng.choice(hosts) + rng.choice(["", "", "/", "/p", "/p/"]), rng.choice(["block", "allow"])) for i in range(25)] + [(90, None, "block"), (91, "", "block")]
    odd = [(1000, None), (1001, ""), (1002, "http:///x"), (1003, "HTTP://USER@A.ORG./p"), (0, urls[0][1]), (None, "a.org")]

    def key(u):
        u = u.strip().split("://", 1)[-1].split("#")[0]
        cut = min([u.find(c) for c in "/?" if c in u] or [len(u)])
        host, rest = u[:cut].rsplit("@", 1)[-1].split(":")[0].lower().rstrip("."), u[cut:]
        return (".".join(reversed(host.split("."))) + ".", rest) if host else None

    def verdict(u):
        k = key(u) if u is not None else None
        if k is None:
            return None, "invalid"
        whole = k[0] + (k[1] if k[1].startswith("/") else "/" + k[1])
        hits = [(-len("".join(key(p))), a != "block", i, a) for i, p, a in rules if p and key(p) and whole.startswith("".join(key(p)))]
        return (min(hits)[2], min(hits)[3]) if hits else (None, "allow")

    pages = spark.createDataFrame([*urls, *odd], "page_id long, url string")
    got = urlfilter.filter_urls(with_clashes(pages), spark.createDataFrame(rules, "rule_id long, pattern string, action string"), parts=4).collect()
    assert sorted(((r["page_id"], r["url"], r["rule_id"], r["action"]) for r in got), key=str) == sorted(((i, u, *verdict(u)) for i, u in [*urls, *odd]), key=str)
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.default_rules(spark)).count() == 0


# licences
def test_licences(spark):
    rng = random.Random(4)
    mit = "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [
        (1, f"{text(rng, 50)} Licensed under the Apache License, Version 2.0 {text(rng, 50)}", "en", "s"),
        (2, f"{mit} ... {text(rng, 40000)} This work is licensed under the GNU General Public License, version 3.", "en", "s"),
        (3, "The licence of this apache software is free of charge under version 2 of the terms", "en", "s"),
        (4, None, None, None), (5, "", "en", "s"), (6, "Released under the MIT License. Released under the MIT License.", "en", "s"), (6, "Released under the MIT License. Released under the MIT License.", "en", "s"), (None, "Licensed under CC BY 4.0", "en", "s"),
    ]
    docs = with_clashes(documents(spark, rows))
    got = sorted(((r["doc_id"] or 0, r["license"]) for r in license.scan_licenses(docs).collect()))
    assert got == [(0, "CC-BY-4.0"), (1, "Apache-2.0"), (2, "GPL-3.0"), (2, "MIT"), *[(6, "MIT")] * 4]
    assert license.scan_licenses(docs.limit(0)).count() == 0


def test_every_template_finds_itself(spark):
    rng = random.Random(5)
    rows = [(i, f"{text(rng, 30)} {t} {text(rng, 30)}", "en", "s") for i, (_, t, _) in enumerate(license.TEMPLATES)]
    got = {(r["doc_id"], r["license"]) for r in license.scan_licenses(documents(spark, rows)).collect()}
    assert got >= {(i, n) for i, (n, _, _) in enumerate(license.TEMPLATES)}


def brute_licences(words, index):
    """All places of all phrases: a template stands where one of its phrases puts it, if all of them stand in the window of its length and slack."""
    found = set()
    for t, (_, _, phrases) in enumerate(index.templates):
        places = [[i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p] for p in phrases]
        for base in {i - at for there, at in zip(places, index.phrase_at[t], strict=True) for i in there}:
            spans = []
            for p, at, there in zip(phrases, index.phrase_at[t], places, strict=True):
                inside = [i for i in there if i >= base - index.slack[t] and i + len(p) <= base + index.length[t] + index.slack[t]]
                if inside:
                    best = min(inside, key=lambda i: abs(i - base - at))
                    spans.append((best, best + len(p)))
            if len(spans) == len(phrases):
                found.add((t, min(s[0] for s in spans), max(s[1] for s in spans)))
    return index.best(list(found))


def test_licences_against_brute_force():
    rng = random.Random(12)
    docs = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(license.TEMPLATES)[1].split()
            kind = rng.random()
            if kind < 0.3:  # a part of it, a word changed or left out
                w = w[: rng.randint(1, len(w))]
            elif kind < 0.5:
                w[rng.randrange(len(w))] = "changed"
            parts += [text(rng, rng.randint(0, 30)), " ".join(w)]
        docs.append(license.words_of(" ".join(parts)))
    df = Counter(w for d in docs for w in set(d))
    index = license.Index(license.TEMPLATES, len(docs), df)
    names = lambda found: [(index.templates[t][0], a, b) for t, a, b in found]
    for d in docs:
        assert names(index.scan(np.array([license.stable_hash(w) for w in d], np.uint64))) == names(brute_licences(d, index))


def test_clauses_and_ties():
    two = f"{license._BSD} {license._BSD_TWO} {license._BSD_END}"
    three = f"{license._BSD} {license._BSD_TWO} {license._BSD_THIRD.replace('the copyright holder', 'Some Software Foundation Inc')} {license._BSD_END}"
    twins = [("B", "one two three", ["one two three"]), ("A", "one two three", ["one two three"])]
    for templates, t, want in ((license.TEMPLATES, two, ["BSD-2-Clause"]), (license.TEMPLATES, three, ["BSD-3-Clause"]), (license.TEMPLATES, license._BSD, ["BSD"]), (twins, "x one two three y", ["A"])):
        index = license.Index(templates, 10, {})
        got = index.scan(np.array([license.stable_hash(w) for w in license.words_of(t)], np.uint64))
        assert [index.templates[k][0] for k, _, _ in got] == want


def test_phrases_are_found_where_no_file_has_the_other_words():
    german = license.words_of("Lizenziert unter der GNU General Public License, version 3, ohne Gewähr")
    index = license.Index(license.TEMPLATES, 100, {w: 100 for w in german})
    got = index.scan(np.array([license.stable_hash(w) for w in german], np.uint64))
    assert [index.templates[t][0] for t, _, _ in got] == ["GPL-3.0"]


# HTML
def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><ul><li><a href='/'>Home</a></li><li><a>News</a></li><li><a>About us</a></li></ul>
    <h1>The heading of it all</h1><p>""" + "many words of text &amp; more " * 12 + """</p><script>var x = "<p>no</p>";</script><p>""" + "another paragraph follows here " * 10 + """</p><div>Copyright 2020 all rights reserved by somebody</div></body>"""
    tree = htmltext.trained_tree()
    out, n, kept = htmltext.extract(page, tree)
    assert "many words of text & more" in out and "another paragraph" in out and "Home" not in out and "var x" not in out and kept < n
    assert htmltext.extract(None, tree) == htmltext.extract("", tree) == ("", 0, 0)
    assert htmltext.extract("<p>unclosed <b>tags <div>and <script> no end", tree)[1] == 2
    table = np.array(htmltext.LABELLED, float)
    assert (htmltext.decide(tree, table[:, :6]) == (table[:, 6] == 1)).mean() >= 0.9


class Plain(HTMLParser):
    """A second parser: blocks by the same tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.unseen, self.linked, self.quiet = [], [], 0, False, False

    def flush(self):
        if self.now:
            self.blocks.append((" ".join(w for w, _ in self.now), len(self.now), sum(a for _, a in self.now)))
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.unseen += tag in htmltext.UNSEEN
        self.quiet = tag == "title" or self.quiet
        self.linked = tag == "a" or self.linked
        if tag in htmltext.BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag):
        self.unseen -= tag in htmltext.UNSEEN
        self.quiet = tag != "title" and self.quiet
        self.linked = tag != "a" and self.linked
        if tag in htmltext.BLOCK_TAGS:
            self.flush()

    def handle_data(self, data):
        if not self.unseen and not self.quiet:
            self.now += [(w, self.linked) for w in data.split()]


def test_blocks_against_a_second_parser():
    rng = random.Random(6)
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(1, 30)):
            w = text(rng, rng.randint(0, 12))
            parts.append(rng.choice([f"<p>{w}</p>", f"<div class='x > y'>{w}", f"<a href=\"/q?a=1&b=<2>\">{w}</a>", f"<!-- <p>{w}</p> -->", f"<script>var a = '<p>{w}</p>';</script>", f"<STYLE>p{{}}</STYLE >{w}", f"<b>{w}</b>", f"{w} &amp; &lt;b&gt;", f"</div><br>{w}", f"<title>{w}</title>", f"a < b {w}", f"<svg><path d='M0'/></svg>{w}"]))
        page = " ".join(parts)
        p = Plain()
        p.feed(page)
        p.close()
        p.flush()
        assert htmltext.blocks(page) == p.blocks


@pytest.mark.parametrize("piece", ["<a ", "<a href=\"x", "<a \"x>y\"", "<", "<!--", "<!", "<script ", "</script   ", "<a '", "&", "<p>", "<p a='>", "<a b=\">\" "])
def test_malformed_pages_take_time_by_their_length(piece):
    """A megabyte; work that grows with the square of it would take hours."""
    began = time.perf_counter()
    for end in ("", ">", "'\">"):
        htmltext.blocks(piece * (1_000_000 // len(piece)) + end)
    assert time.perf_counter() - began < 20


def test_the_tree_keeps_the_articles():
    """Blocks of pages that the table doesn't have."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()[50:]
    tree, right = htmltext.trained_tree(), []
    for r in pages:
        page = r["html"]
        a, e = page.find("<article>"), page.find("</article>")
        before, inside = len(htmltext.blocks(page[:a])), len(htmltext.blocks(page[a:e]))
        bs = htmltext.blocks(page)
        want = np.zeros(len(bs), bool)
        want[before : before + inside] = True
        right.append(htmltext.decide(tree, htmltext.features(bs)) == want)
    assert np.concatenate(right).mean() > 0.97


def test_html_table(spark):
    rows = [(1, "u", "<p>" + "word " * 50000), (1, "u", "<p>" + "word " * 50000), (2, None, None), (3, "u", ""), (None, "u", "<div>x</div>"), (4, "u", "<a " * 300_000)]
    got = htmltext.extract_html(with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r["page_id"] or 0, r["n_blocks"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0), (4, 1)]
    assert htmltext.extract_html(spark.createDataFrame([], "page_id long, html string")).count() == 0


# audio
def test_resampling_a_tone():
    for rate in (8000, 11025, 44100, 48000):
        t = np.arange(rate) / rate
        y = audio.resample(np.sin(2 * np.pi * 440 * t), rate)
        assert len(y) == audio.RATE
        want = np.sin(2 * np.pi * 440 * np.arange(audio.RATE) / audio.RATE)
        assert np.abs(y - want)[800:-800].max() < 0.01


def test_resampling_against_the_plain_sum():
    x = np.random.default_rng(1).standard_normal(300)
    h = audio.branches(2, 1)
    y, taps = audio.resample(x, 8000), audio.branches(2, 1).shape[1]
    for n in (100, 101, 350):
        k = n // 2 + np.arange(taps) - taps // 2
        assert y[n] == pytest.approx(sum(x[i] * c for i, c in zip(k, h[n % 2][::-1], strict=True) if 0 <= i < len(x)), abs=1e-5)


def test_segments_and_mel():
    x = np.concatenate([np.zeros(4000), 0.5 * np.sin(np.arange(8000)), 0.005 * np.sin(np.arange(1600)), np.zeros(4000), 0.012 * np.sin(np.arange(4000))])
    got = audio.segments(audio.level(audio.frames_of(x)))
    assert len(got) == 1 and abs(got[0][0] - 4000 / 160) <= 3  # the last sound never reaches the upper level
    tone = audio.log_mel(audio.frames_of(0.5 * np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)))
    hz = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 42)[1:-1] / 2595) - 1)
    assert abs(hz[tone.mean(axis=0).argmax()] - 1000) < 80


def test_mel_and_segments_against_plain_sums():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(1500) * s for s in (0.001, 0.3, 0.02, 0.002, 0.02, 0.2, 0.0)])
    f = audio.frames_of(x)
    assert len(f) == audio.n_frames(len(x)) and (len(f) - 1) * 160 + 400 >= len(x)  # every sample is in a frame
    t, k = np.arange(400), np.arange(257)[:, None]
    wave = np.exp(-2j * np.pi * k * t / 512)
    top = 2595 * np.log10(1 + 8000 / 700)
    edge = [700 * (10 ** (top * i / 41 / 2595) - 1) for i in range(42)]
    mel = audio.log_mel(f)
    for i in (0, 7, len(f) - 1):
        y = [x[i * 160 + j] * (0.5 - 0.5 * np.cos(2 * np.pi * j / 400)) if i * 160 + j < len(x) else 0.0 for j in t]
        power = np.abs(wave @ np.array(y)) ** 2
        for m in (0, 11, 39):
            tri = [max(0.0, min((h - edge[m]) / (edge[m + 1] - edge[m]), (edge[m + 2] - h) / (edge[m + 2] - edge[m + 1]))) for h in np.arange(257) * 16000 / 512]
            assert mel[i, m] == pytest.approx(np.log(max(power @ tri, 1e-10)), abs=2e-3)
    db = [10 * np.log10(max(sum(v * v for v in w) / 400, 1e-10)) for w in f.tolist()]
    on, want, began = False, [], 0
    for i, v in enumerate([*db, -999.0]):  # hysteresis, frame by frame, and back to where the lower level was reached
        if not on and v >= -30:
            on, began = True, i
            while began and db[began - 1] >= -40:
                began -= 1
        if on and v < -40:
            on = False
            want.append((began, i))
    assert audio.segments(audio.level(f)) == want and want


def test_a_long_clip_is_worked_off_in_slices():
    rng = np.random.default_rng(4)
    x = (rng.standard_normal(400_000) * 3000).astype(np.int16)
    y = audio.resample(x, 11025)
    n, mel, db = audio.analysed(x, 11025)
    f = audio.frames_of(y)
    assert n == len(y) > 4 * audio.SLICE and np.allclose(mel, audio.log_mel(f), atol=1e-4) and np.allclose(db, audio.level(f), atol=1e-4)
    pieces = np.concatenate(list(audio.resampled(x, 11025, most=5000)))
    assert np.allclose(pieces, y, atol=1e-5)


def test_audio_table(spark, tmp_path):
    pcm = (0.5 * np.sin(np.arange(16000)) * 32767).astype("<i2").tobytes()
    rows = [(1, pcm, 16000), (1, pcm, 16000), (2, None, 16000), (3, b"", 8000), (4, pcm, None), (5, pcm, 0), (6, pcm[:10], 8000), (None, pcm, 16000), (7, pcm[:9], 16000), (8, pcm * 400, 16000)]
    clips = with_clashes(spark.createDataFrame(rows, "id long, samples binary, rate int"))
    out = audio.audio_features(clips, ["id"])
    got = out.collect()
    n = Counter(r["id"] for r in got)
    assert n[1] == 2 * n[None] and n[6] == n[7] == 1 and not n.keys() & {2, 3, 4, 5}
    for r in got:
        assert len(r["log_mel"]) == audio.FRAMES * audio.MELS and 0 <= r["t_start"] < r["t_end"]
    assert max(r["t_end"] for r in got if r["id"] == 8) == 400 and n[8] == -(-audio.n_frames(400 * 16000) // audio.FRAMES)
    t = audio.as_tensors(out.filter("id = 1").toArrow())
    assert t.type.shape == [audio.FRAMES, audio.MELS] and t.to_numpy_ndarray().shape == (n[1], audio.FRAMES, audio.MELS)
    out.write.parquet(str(tmp_path / "features"))
    assert sum(b.num_rows for b in audio.read_tensors(str(tmp_path / "features"))) == len(got)
    assert all(b.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.FRAMES, audio.MELS)) for b in audio.read_tensors(str(tmp_path / "features")))
    assert audio.audio_features(clips.limit(0), ["id"]).count() == 0


def test_there_is_a_query_for_each():
    assert [int(n[2:].split("_")[0]) for n in Q.QUERIES] == list(range(1, 11)) and pa is not None
