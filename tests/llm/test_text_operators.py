"""Quality rules, packing, language identification, page text and top-k against plain versions."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import html, langid, packing, quality, topk

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello  wörld's 123 <|endoftext|> a\x1cb É́ !!..", "", None, "aaaaaaa" * 50, "ΣΑΣ İstanbul ﬁ \xa0  x é 日本語テキスト 👩‍👩‍👧 x" * 3, "it's they'll I'M <|startoftext|>x<|endoftext|>", "̀abc ̀", "a" * 1000 + "b" * 33, " ", "１２３ ⅷ ²", "don't''s'll", "﻿x​y", "tab\tand\x0bfeed\x0c\r\n"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def documents(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_packing_is_gapless_and_complete(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = ODD + documents(spark) + ["word " * 9000]
    rows = packing.pack(frame(spark, texts), PATH).collect()
    windows, pieces = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length <= 2048
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in enumerate(texts):
        got = [x for _, ids, _ in sorted(pieces[i]) for x in ids]
        assert got == [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert {n for _, _, n in pieces[i]} == {len(got)}
    assert packing.pack(frame(spark, ["x"]).limit(0), PATH).collect() == []


def test_best_fit_takes_the_tightest_window():
    lengths = np.random.default_rng(1).integers(1, 101, 400)
    where, offset, n = packing.best_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [w for w in range(len(room)) if room[w] >= lengths[i]]
        if not fits:
            room.append(100)
            fits = [len(room) - 1]
        best = min(room[w] for w in fits)
        assert 100 - offset[i] == best
        w = next(w for w in fits if room[w] == best)
        room[w] -= lengths[i]
    assert n == len(room) and len(set(where)) == n


def plain_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found = {}
    for i in range(len(w) - 7):
        found.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in found.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(covered)


def test_quality_measures_and_hosts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "\n\n a\n a\na", "x " * 40, "# * $"]
    for _ in range(80):
        b = [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(4)]
        texts.append("".join(rng.choice(b) + rng.choice([" ", "\n", "\t\r\n", "  é# "]) for _ in range(rng.randint(0, 12))))
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, t, f"h{i % 3}") for i, t in enumerate(texts)] + [(1000 + i, good if i % 10 else "bad", "fine.example") for i in range(50)] + [(2000 + i, "bad" if i % 10 else good, "bad.example") for i in range(50)] + [(3000, good, None)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        m = plain_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
    assert all(got[1000 + i].kept == bool(i % 10) for i in range(50)) and not any(got[2000 + i].kept for i in range(50))
    assert quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string").limit(0)).collect() == []


def test_hosts_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(30)) if i % 4 else "x", f"h{i % 9}" if i % 5 else None) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = sorted(map(tuple, quality.quality(docs).collect()), key=str)
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, quality.quality(docs).collect()), key=str) == near


def test_language_gradients():
    net = langid.ByteNet(["a", "b"], 4, 3)
    x = np.random.default_rng(0).integers(0, 256, (5, 20)).astype(np.uint8)
    y = np.array([0, 1, 0, 1, 1])
    grads = net._gradients(x, y)

    def loss():
        return -np.log(langid.scores(net.folded(), x)[np.arange(5), y]).mean()

    for k in ("o", "w2", "w4", "e"):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        v = net.p[k][at]
        net.p[k][at] = v + 2e-3
        up = loss()
        net.p[k][at] = v - 2e-3
        down = loss()
        net.p[k][at] = v
        assert abs((up - down) / 4e-3 - grads[k][at]) < 2e-3


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.language(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (None, "12 !", None), (2, "of the", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.language(odd).collect()} == {"und"}
    assert langid.language(odd.limit(0)).collect() == []


def test_pages_give_the_text_that_was_put_in(spark):
    weight = html.weights()
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no no no no</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">Home page of the site</a></li></ul></nav><!-- a <p>comment that is long enough</p> --><article><header><h1>Title &amp; more</h1></header>
    <p><b>First  line<br>goes on.</p><div class="ad">Buy this now and again and again</div><p>Caf&eacute; &lt;tag&gt; <a href="x>y">link</a>s here.<p>Last
    paragraph.</article><section class="comments"><p>I think that this is wrong and long enough</p></section><footer>&copy; me and all of my friends"""
    assert html.main_text(page, weight) == "Title & more\nFirst line goes on.\nCafé <tag> links here.\nLast paragraph."
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<nav><a>x</a></nav>"), (None, "z", "<p>" * 20000 + "deep down there is a line of text that nobody ever closed")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text.count("\n") for r in got[:2]] == [3, 3] and [r.text for r in got[2:5]] == ["", "", ""] and got[5].text == "deep down there is a line of text that nobody ever closed"


def test_pages_of_the_table(spark):
    import html as h

    weight = html.weights()
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = (" ".join(h.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert html.main_text(r.html, weight) == "\n".join(x for x in parts if x)


def test_best_run():
    rng = random.Random(2)
    for _ in range(200):
        v = [rng.randint(-3, 3) for _ in range(rng.randint(0, 12))]
        a, b = html.best_run(v)
        assert sum(v[a:b]) == max(sum(v[i:j]) for i in range(len(v) + 1) for j in range(i, len(v) + 1))


def plain_scores(net, x):
    """The network written down plainly: embed, slide each filter, take its largest response, softmax."""
    out = []
    for row in x:
        e, h = net.p["e"][row], []
        for w in langid.WIDTHS:
            responses = np.stack([e[i : i + w].reshape(-1) @ net.p[f"w{w}"] for i in range(len(row) - w + 1)])
            h.append(np.maximum(responses.max(0) + net.p[f"b{w}"], 0))
        z = np.concatenate(h) @ net.p["o"] + net.p["c"]
        q = np.exp(z - z.max())
        out.append(q / q.sum())
    return np.array(out)


def test_language_is_a_plain_pass_over_all_windows(spark, monkeypatch):
    net = langid.ByteNet(["aa", "bb", "cc"], 4, 3, seed=9)
    monkeypatch.setattr(langid, "train", lambda *_: (net.labels, net.folded()))
    texts = [t for t in documents(spark)[:40] if t] + ["x", "é" * 100, "words " * 20_000, "a" * 128, "b" * 129]
    rows = spark.createDataFrame([(i, t, "aa", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, x int").withColumnRenamed("x", "TEXT")
    for r in langid.language(rows).collect():
        body = texts[r.doc_id].encode()
        cut = [np.frombuffer(body[i : i + 128].ljust(128), np.uint8) for i in range(0, len(body), 128)]
        mean = plain_scores(net, cut[:400]).mean(0) if len(cut) <= 400 else langid.scores(net.folded(), np.array(cut)).mean(0)
        assert r.lang_pred == net.labels[mean.argmax()] and abs(r.score - mean.max()) < 1e-4


def test_language_learns_from_whole_texts(spark, monkeypatch):
    seen = []
    fit = langid.ByteNet.fit
    monkeypatch.setattr(langid.ByteNet, "fit", lambda self, x, y, **more: seen.append(x) or fit(self, x[:64], y[:64], epochs=1))
    rows = spark.createDataFrame([(3 * i, f"{i} " + "text of some length " * 50, "ab"[i % 2]) for i in range(30)], "doc_id long, text string, lang string")
    langid.train(rows.withColumn("learn", F.lit(True)))
    assert len(seen[0]) == sum(-(-len(r.text) // 128) for r in rows.collect())


def test_measures_of_long_texts_and_clashing_columns(spark):
    long = "word " * 200_000 + "\n" + "é" * 100_000
    rows = spark.createDataFrame([(1, long, "h", 1), (None, "a b", None, 1)], "doc_id long, text string, source string, x int").withColumnRenamed("x", "TEXT")
    got = {r.doc_id: r for r in quality.quality(rows).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].n_repeat_words) == (200_001, 900_000, 200_000) and got[1].base_failed
    assert got[None].n_words == 2


def test_packing_of_null_ids_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, "a b", 1), (2, None, 1)], "doc_id long, text string, x int").withColumnRenamed("x", "TEXT")
    assert sorted(((r.doc_id, r.length) for r in packing.pack(rows, PATH).collect()), key=str) == [(2, 1), (None, 3)]


@pytest.mark.parametrize("block", [8192, 3])
def test_top_k_matches_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 20)]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(20)] + [(400, None), (450, [1.0, None]), (500, [float("nan")] * 20), (550, [float("inf")] * 20), (600, [0.5] * 3), (650, [1.5] * 40), (700, [])]
    got = {}
    data = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).toDF("vec_id", "embedding", "Vec_ID"))
    for r in topk.top_k(data, data.where("vec_id % 50 = 0"), block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in ints if i % 50 == 0):
        score = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(score[:5])]
    assert set(got) == {i for i in ints if i % 50 == 0}
    assert topk.top_k(data.limit(0), data.where("vec_id % 50 = 0")).collect() == [] and topk.top_k(data, data.limit(0)).collect() == []


def test_top_k_prunes_before_exact_products():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (20, 64))
    rows = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 20, (4000, 64))).astype(np.int64)
    best = topk.Best(rows[:10], np.arange(10), 5)
    for i in range(0, 4000, 500):
        best.look(rows[i : i + 500], np.arange(i, i + 500))
    assert best.exact < 0.5 * best.pairs
    assert topk._exact(np.array([[2**40]]), np.array([[2**40], [1]])).tolist() == [[2**63 - 1, 2**40]]
