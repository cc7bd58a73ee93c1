"""BPE encoding against the library: texts, every character, random strings."""

from __future__ import annotations

import collections
import random
import re
import unicodedata

import numpy as np
import pytest

from annalist.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello  wörld's 123 <|endoftext|> a\x1cb É́ !!..", "", None, "aaaaaaa" * 50, "ΣΑΣ İstanbul ﬁ \xa0  x é 日本語テキスト 👩‍👩‍👧 x" * 3, "it's they'll I'M <|startoftext|>x<|endoftext|>", "̀abc ̀", "a" * 1000 + "b" * 33, " ", "１２３ ⅷ ²", "don't''s'll", "﻿x​y", "tab\tand\x0bfeed\x0c\r\n", "'re'VE×'s÷'ll 's' ''s é'sé'"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def documents(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path = tmp_path_factory.mktemp("bpe") / "tables"
    path.write_bytes(bpe.compiled(PATH))
    return bpe.mapped(str(path))


def encoded(e, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, n = e.encode(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_matches_the_library(spark, library):
    texts = ODD + documents(spark) + ["long words " * 300_000]
    for r in bpe.bpe_encode(frame(spark, texts), PATH).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens) == (want, len(want))
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_forgets_and_relearns(tables):
    e = bpe.Encoder(tables, keep=3)
    texts = ["one two three four", "five one été", "", "one two three four"]
    once = encoded(e, texts)
    assert [encoded(e, [t])[0] for t in texts] == once


def test_every_character(tables, library):
    e = bpe.Encoder(tables)
    points = [c for c in (*range(0x32400), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    for form in ("{}", "a{}b"):
        texts = [form.format(chr(c)) for c in points]
        want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert [hex(c) for c, a, b in zip(points, encoded(e, texts), want, strict=True) if a != b] == []


def test_random_strings(tables, library):
    e, rng = bpe.Encoder(tables), random.Random(5)
    odd = [chr(c) for c in range(0x300, 0x20000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c)) or chr(c).lower() != chr(c))]
    new = [chr(c) for c in (0x1C89, 0xA7CB, 0xC5C, 0xA7DA, 0x130, 0x3A3, 0x17F, 0x212A, 0x7FD, 0x898, 0x11938, 0x11935, 0x11930)]
    common = [*"aeiouSTRVL''  .,!?1290\t\n|<>éÉÀß×÷ÿñ", "'s", "'re", "'Ll", "''", "<|endoftext|>", "<|", "tion", "the", "é", "́", "\xa0", "\x1c"]
    texts = ["".join(rng.choice(common if rng.random() < 0.7 else odd if rng.random() < 0.7 else new) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, encoded(e, texts), want, strict=True) if a != b] == []


def test_frequent_words_are_counted_and_change_nothing(spark):
    texts = documents(spark)
    top = bpe.frequent_words(frame(spark, texts), 50)
    plain = collections.Counter(w for t in texts if t for w in re.findall(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+", t.lower()))
    least = min(plain[w.decode()] for w in top)
    assert 20 < len(top) <= 50 and {w.encode() for w, n in plain.items() if n >= least and len(w.encode()) <= 16} == set(top)
    rows = frame(spark, ODD + texts[:50])
    assert bpe.bpe_encode(rows, PATH, (b"thtion", b"zzzzq", b"hello")).collect() == bpe.bpe_encode(rows, PATH).collect()
    assert bpe.frequent_words(rows.limit(0)) == () and bpe.bpe_encode(rows.limit(0), PATH).collect() == []


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, "a b", 1), (1, "a b", 1), (1, "a b", 1), (2, None, 1)], "doc_id long, text string, x int").withColumnRenamed("x", "TEXT")
    assert sorted(((r.doc_id, r.n_tokens) for r in bpe.bpe_encode(rows, PATH).collect()), key=str) == [(1, 2), (1, 2), (2, 0), (None, 2)]


def test_automaton_numbers_every_word():
    words = sorted({bytes(random.Random(i).choices(b"abc", k=1 + i % 7)) for i in range(300)})
    tables = bpe.compile_words(words)
    letters, lengths = bpe._matrix([*words, b"abcabcabc", b"d"])
    assert bpe.look_up(tables, letters, lengths).tolist() == [*range(len(words)), -1, -1]


def test_merging_in_bulk_and_one_by_one_agree(tables):
    words = [bytes(random.Random(i).choices(b"etaoin'\xc3\xa9", k=1 + i % 20)) for i in range(400)]
    ids, n = bpe.merge_words(tables, *bpe._matrix(words))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [bpe.merge_long(tables, w) for w in words]
