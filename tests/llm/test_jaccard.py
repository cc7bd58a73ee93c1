"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from annalist.llm import common as C
from annalist.llm import jaccard
from annalist.llm.components import components


def shingle_set(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(docs):
    sets = {k: shingle_set(v) for k, v in docs.items()}
    reps = {}
    for k in sorted(sets):
        if sets[k]:
            reps.setdefault(sets[k], k)
    rows = list(reps.items())
    links, parent = {k: 0 for _, k in rows}, {k: k for _, k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(rows):
        for b, q in rows[:i]:
            c = len(a & b)
            if 5 * c >= 4 * (len(a) + len(b) - c):
                links[p] += 1
                links[q] += 1
                x, y = root(p), root(q)
                parent[max(x, y)] = min(x, y)
    copies = Counter(sets.values())
    return {k: (root(reps[s]), copies[s], links[reps[s]]) if s else (k, 1, 0) for k, s in sets.items()}


def some_docs():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    docs, k = {}, 0
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            x = list(base)
            for _ in range(rng.randint(0, 5)):
                x[rng.randrange(len(x))] = rng.choice(words)
            docs[k] = " ".join(x) if rng.random() < 0.8 else "\n".join(x).upper()
            k += 1
    return docs | {900: None, 901: "", 902: " ", 903: "one two", 904: "One  two"}


@pytest.mark.parametrize("block", [1024, 2])
def test_links_and_classes_match_all_pairs(spark, block):
    docs = some_docs()
    base = C.keyed(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    got = {r.key: (r.class_key, r.n_copies, r.n_links) for r in jaccard.near_duplicates(base, block=block).collect()}
    assert got == brute(docs)


def test_band_counts_meet_the_recall():
    bands, rows = jaccard.bands_for(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and bands * rows <= 256


def test_repeated_and_null_rows(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.class_id, r.n_copies, r.n_links) for r in jaccard.jaccard_join(d).collect()) == [("1", 1, 3, 0), ("1", 1, 3, 0), ("2", 2, 1, 0), ("None", 1, 3, 0)]
    assert jaccard.jaccard_join(d.limit(0)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2))] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_chained_candidates_cost_no_squares(spark):
    """A chain of sets, each sharing a band with the next one only, goes to its buckets; a tight group goes to pairs of blocks."""
    chain = [(i, [i // 2, (i + 1) // 2 + 10**6]) for i in range(4000)]
    units = jaccard.candidate_units(spark.createDataFrame(chain, "rep long, bands array<long>"), 100).collect()
    assert len(units) <= 2 * len(chain) and {r.blocks for r in units} == {1} and {r.band for r in units} == {0, 1}
    tight = [(i, [7, 8, 9]) for i in range(1000)]
    units = jaccard.candidate_units(spark.createDataFrame(tight, "rep long, bands array<long>"), 100).collect()
    assert len(units) == 1000 and {(r.blocks, r.band) for r in units} == {(10, -1)}


def test_links_of_large_chained_groups(spark, monkeypatch):
    """Texts in a row, each with most of the one before: a few links each, in one group of candidates."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    docs, now = {}, [rng.choice(words) for _ in range(80)]
    for k in range(300):
        docs[k] = " ".join(now)
        now = now[rng.choice((8, 10, 10)) :]
        now += [rng.choice(words) for _ in range(80 - len(now))]
    base = C.keyed(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    used = []
    plain = jaccard.candidate_units
    monkeypatch.setattr(jaccard, "candidate_units", lambda sets, block: used.append(plain(sets, block)) or used[-1])
    got = {r.key: (r.class_key, r.n_copies, r.n_links) for r in jaccard.near_duplicates(base, block=3).collect()}
    assert got == brute(docs)
    assert used[0].where("band >= 0").count() > 0


def test_recall_on_a_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = {r.doc_id: r.text for r in rows.collect()}
    want, got = brute(docs), {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in jaccard.jaccard_join(rows).collect()}
    linked = sum(w[2] for w in want.values())
    assert linked > 0 and sum(got[k][2] for k in got) >= 0.9 * linked and all(got[k][2] <= want[k][2] for k in got)
    assert sum(got[k] == want[k] for k in got) >= 0.99 * len(got)


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    d = spark.createDataFrame([(1, long, 1), (2, long + " x", 1), (3, "other words that are few", 1)], "doc_id long, text string, x int").withColumnRenamed("x", "Text")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(d).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
