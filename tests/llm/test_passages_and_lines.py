"""Suffix dedup and line dedup against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from annalist.llm import lines, suffix
from annalist.llm.spans import span_hashes

LENGTH = 100


def brute_passages(docs):
    seen, out = set(), {}
    for k in sorted(docs):
        b = (docs[k] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            w = b[i : i + LENGTH]
            if w in seen:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        out[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def some_docs(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(90, 400))) for _ in range(8)]
    docs = {k * 3: "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(rng.randint(0, 8))) for k in range(80)}
    return docs | {5: "a" * 1000, 7: "ab" * 700, 8: docs[3], 10: docs[3], 11: "x" + "a" * 300, 13: None, 14: ""}


@pytest.mark.parametrize("hot", [50_000, 3, 1, 0])
def test_passages_of_hot_and_cold_buckets(spark, hot):
    """Pairs that differ in the last byte share an anchor in a bucket of two; the six variants of one text make a hot one."""
    rng = random.Random(6)

    def text():
        return "".join(rng.choice("abcdefghijklmnop ") for _ in range(LENGTH - 1))

    docs = {}
    for i in range(30):
        t = text()
        docs[2 * i], docs[2 * i + 1] = t + "x", t + "y"
    t = text()
    docs |= {100 + i: t + "uvwxyz"[i] for i in range(6)}
    docs |= {200 + i: docs[i] + text() + docs[100 + i % 6] + docs[i] for i in range(12)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.suffix_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1), hot_segments=hot).collect()}
    assert got == brute_passages(docs)


@pytest.mark.parametrize("hot", [50_000, 3, 0])
def test_passages_match_brute_force(spark, hot):
    docs = some_docs(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.suffix_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), hot_segments=hot).collect()}
    assert got == brute_passages(docs)


def test_windows_sorted_by_difference_cover():
    rng = random.Random(1)
    t = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(1500)) + b"abc" * 200 + b"a" * 400, np.uint8)
    t = np.concatenate([t, t[300:900], t[100:500]])
    at = np.arange(len(t) - LENGTH + 1)
    new = suffix.new_windows(t, at, np.zeros(len(at), np.int64), at, LENGTH)
    seen, want = set(), []
    for i in at:
        want.append(t[i : i + LENGTH].tobytes() not in seen)
        seen.add(t[i : i + LENGTH].tobytes())
    assert new.tolist() == want
    last = b""
    for own, _ in suffix.sort_windows(t, at, LENGTH, block=500):
        for i in own:
            assert last <= t[at[i] : at[i] + LENGTH].tobytes()
            last = t[at[i] : at[i] + LENGTH].tobytes()


def test_long_texts_are_cut_into_sections(spark, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij ") for _ in range((1 << 20) + 5000))
    docs = {1: long, 2: "zz" + long[1000:2000] + long[(1 << 20) - 300 : (1 << 20) + 300]}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.suffix_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == {1: (len(long), 0, 0), 2: (1602, 1600, 1)}


def test_passages_of_repeated_and_null_rows(spark):
    d = spark.createDataFrame([(1, "q" * 150, 0), (1, "q" * 150, 0), (None, "q" * 150, 0), (2, None, 0), (2, "", 0)], "doc_id long, text string, TEXT2 int").withColumnRenamed("TEXT2", "Text")
    with_clash = suffix.suffix_dedup(d).select("doc_id", "n_bytes", "n_removed").collect()
    assert sorted(map(tuple, with_clash), key=str) == sorted([(1, 150, 149), (1, 150, 150), (None, 150, 150), (2, 0, 0), (2, 0, 0)], key=str)
    assert suffix.suffix_dedup(d.limit(0)).collect() == []


def test_whole_characters_go(spark):
    from annalist.llm import common as C

    shared = "é" * 60
    d = spark.createDataFrame([(1, "a" + shared), (2, "b" + shared + "c")], "doc_id long, text string")
    kept = {r.key: bytes(r.kept).decode() for r in suffix.dedup_passages(C.keyed(d), whole_characters=True).collect()}
    assert kept[2] == "bc"


def brute_lines(docs):
    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    first = {}
    for k in sorted(docs):
        for x in (docs[k] or "").split("\n"):
            first.setdefault(key(x), k)
    out = {}
    for k, t in docs.items():
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 10 or first[key(x)] == k]
        out[k] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_lines_match_brute_force(spark, batches, fanout):
    rng = random.Random(9)
    pool = ["  Some Common Line é", "some common line é\t", "short", "", " \t", "Éléphant ligne", "éléphant ligne", "a much longer line of text %d"]
    docs = {k: "\n".join((rng.choice(pool) + ("" if rng.random() < 0.6 else str(rng.randint(0, 40)))) for _ in range(rng.randint(0, 9))) for k in range(60)} | {100: None, 101: "\n", 102: "one two three\r\none two three\r"}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.line_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), batches=batches, fanout=fanout).collect()}
    assert got == brute_lines(docs)


def test_lines_that_a_polynomial_confuses_stay(spark):
    turn = [bin(i).count("1") % 2 for i in range(4096)]
    docs = {n: "".join("ab"[b ^ (n % 2)] for b in turn[:size]) for n, size in enumerate((1024, 1024, 2048, 2048, 4096, 4096))}
    assert [r.n_dropped for r in lines.line_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()] == [0] * 6


def test_span_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    lo = rng.integers(0, 2400, 4000)
    hi = lo + np.concatenate([rng.integers(0, 30, 3000), rng.integers(480, 600, 1000)])
    a, b = span_hashes(data, lo, hi)
    (c,) = span_hashes(data, lo, hi, 1)
    body = [data[x:y].tobytes() for x, y in zip(lo, hi, strict=True)]
    first: dict = {}
    for x, h in zip(body, zip(a.tolist(), b.tolist(), strict=True), strict=True):
        assert first.setdefault(x, h) == h
    assert len(set(first.values())) == len(first) == len({h for h, _ in first.values()}) == len({h for _, h in first.values()})
    assert (a == c).all()


def test_runs_are_neither_shuffled_nor_sorted_again(spark):
    runs = lines.LineRuns(spark, 3, fanout=2)
    frames = [spark.createDataFrame([(i, -i, 10 * t + i % 7) for i in range(40 * t, 40 * t + 60)], "h1 long, h2 long, key long") for t in range(5)]
    for f in frames[:3]:
        runs.add(f)
    assert [level for level, _ in runs.runs] == [1, 0]
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    new = frames[3].repartition(3, "h1", "h2").groupBy("h1", "h2").agg(F.min("key"))
    plan = new.join(spark.table(runs.runs[0][1]).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "false")
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "SortMergeJoin" in plan
    for f in frames[3:]:
        runs.add(f)
    rows = runs.owners().collect()
    assert sorted((r.h1, r.key) for r in rows) == [(i, 10 * max(0, -(-(i - 59) // 40)) + i % 7) for i in range(220)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("annalist_run")]


def test_lines_of_repeated_and_null_rows(spark):
    d = spark.createDataFrame([(1, "the same long line"), (1, "the same long line"), (None, "the same long line"), (3, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in lines.line_dedup(d).collect()) == [("1", 1, 0), ("1", 1, 1), ("3", 1, 0), ("None", 1, 1)]
    assert lines.line_dedup(d.limit(0)).collect() == []
