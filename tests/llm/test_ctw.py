"""Context-tree weighting against a plain recursive version."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from annalist.llm import ctw


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_scores_match_the_recursion(spark):
    rng = random.Random(2)
    docs = {i: " ".join(rng.choice(["the", "Cat", "dog", "é", "run", f"xyz{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 30))) for i in range(40)}
    docs |= {100: None, 101: "  \n ", 102: "\tA\x0bb  c"}
    depth = ctw.DEPTH
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(w for i, t in docs.items() if not out[i] for w in [*words(t), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    nodes, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def decisions(t):
        s = b"\n" * depth + b" ".join(w.encode() for w in words(t)) + b"\n"
        for i in range(depth, len(s)):
            for j in range(8):
                yield [(s[i - d : i], (1 << j) | (s[i] >> (8 - j))) for d in range(depth + 1)], (s[i] >> (7 - j)) & 1

    for i, t in docs.items():
        if not out[i]:
            for path, bit in decisions(t):
                for a in path:
                    nodes[a][bit] += 1
                for a, b in zip(path, path[1:], strict=False):
                    children[a].add(b)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    memo = {}

    def weighted(x):
        if x not in memo:
            own = kt(*nodes[x])
            memo[x] = own if len(x[0]) == depth else np.logaddexp(own, sum(map(weighted, children[x]))) + math.log(0.5)
        return memo[x]

    def chance(path, bit):
        p = None
        for a in reversed(path):
            if a in nodes:
                own = (nodes[a][bit] + 0.5) / (sum(nodes[a]) + 1)
                if p is None:
                    p = own
                else:
                    w = 1 / (1 + math.exp(max(-700, min(700, sum(map(weighted, children[a])) - kt(*nodes[a])))))
                    p = w * own + (1 - w) * p
        return 0.5 if p is None else p

    got = {r.doc_id: r for r in ctw.ctw_score(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    for i, t in docs.items():
        own, r = [*words(t), "\n"], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(own), sum(counts[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), abs=1e-8)
        assert r.score == pytest.approx(sum(math.log10(chance(*x)) for x in decisions(t)), abs=1e-7)


def test_predictions_sum_to_one():
    rng = np.random.default_rng(1)
    grams = np.unique((rng.integers(0, 3, (300, 6)) + 97) @ (256 ** np.arange(5, -1, -1)))
    tree = ctw.Tree(grams, rng.integers(0, 5, len(grams)), 0)
    contexts = np.array([97 * 0x0101010101, 98 * 0x0101010101, 99 + (120 << 32)])
    for c in contexts:
        assert (10 ** ctw.predict(tree.levels, (c << 8) + np.arange(256))).sum() == pytest.approx(1)


def test_repeated_null_and_empty(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = ctw.ctw_score(d).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.train_tokens) for r in got) == [("1", False, 3, 6), ("1", False, 3, 6), ("None", True, 2, 6)]
    assert ctw.ctw_score(d.limit(0)).collect() == []
