"""Context-tree weighting over bytes, trained and scored in packed exchanges.

A text is its words, each followed by a space, the last by an end symbol.  Every
byte is eight binary decisions; each decision has a context tree of its own over
the ``DEPTH`` bytes before it.  A node with counts (a, b) has the
Krichevsky-Trofimov probability of its sequence; from the leaves up,
    P_w(node) = (P_kt(node) + product of P_w(children)) / 2,
and a prediction mixes the estimates of all depths with the weights that this
gives.  A context never seen in training takes the estimate of the deepest one
on its path that was, so every prediction is a proper distribution.

Texts are dealt to groups.  A group sends its distinct (context, byte) grams and
words, with training counts, to buckets; a bucket holds all grams that share
their last two context bytes, so all tree nodes of depth two and more, and
returns a code length for each gram that a group asked for.  Only the two top
levels (at most 65,280 nodes, whatever the corpus) pass through the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import common as C
from annalist.llm.jaccard import word_spans
from annalist.llm.lines import _LOWER
from annalist.llm.spans import span_hashes

DEPTH = 5
END, GAP = 10, 32
HEADS = 16
CHUNK = 1 << 20
GRAMS, WORDS, ASKED, TREE, TOP, STAT, COUNTS, LENGTHS = range(1, 9)
_HALF = math.log(0.5)
_SMALL = 256
_LGAMMA = {shift: np.array([math.lgamma(i + shift) for i in range(_SMALL)]) for shift in (0.5, 1.0)}


def _lgamma(n: np.ndarray, shift: float) -> np.ndarray:
    x = np.maximum(n, 1) + shift
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, _LGAMMA[shift][np.minimum(n, _SMALL - 1).astype(np.int64)], big)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a zeros and b ones, in any one order, under the Krichevsky-Trofimov estimator."""
    return _lgamma(a, 0.5) + _lgamma(b, 0.5) - 2 * math.lgamma(0.5) - _lgamma(a + b, 1.0)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return (k[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values))


def bit_nodes(context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree nodes (context * 256 + bits so far after a leading one) with their counts of zeros and ones."""
    keys, zeros, ones = [], [], []
    for j in range(8):
        node = (1 << j) | (byte >> (8 - j))
        bit = (byte >> (7 - j)) & 1
        k, a, b = _sums((context << 8) | node, np.where(bit == 0, count, 0), np.where(bit == 1, count, 0))
        keys.append(k)
        zeros.append(a)
        ones.append(b)
    k, a, b = (np.concatenate(x) for x in (keys, zeros, ones))
    order = np.argsort(k, kind="stable")
    return k[order], a[order], b[order]


def weigh(level: tuple[np.ndarray, ...], below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log P_w, weight of the node's own estimate) of nodes; ``below``: the summed log P_w of each one's children."""
    kt = log_kt(level[1], level[2])
    if below is None:
        return kt, np.ones(len(kt))
    return np.logaddexp(kt, below) + _HALF, 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))


def up(keys: np.ndarray) -> np.ndarray:
    """The node one byte of context shallower."""
    return (keys >> 16 << 8) | (keys & 255)


class Tree:
    """Levels ``top`` to DEPTH of the nodes of some grams: per depth (keys, zeros, ones, weight)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, top: int) -> None:
        seen = counts > 0
        context, byte, counts = grams[seen] >> 8, grams[seen] & 255, counts[seen].astype(np.float64)
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}
        below = None
        for d in range(DEPTH, top - 1, -1):
            k, n = _sums(((context >> (8 * (DEPTH - d))) << 8) | byte, counts)
            nodes = bit_nodes(k >> 8, k & 255, n)
            lw, weight = weigh(nodes, below)
            self.levels[d] = (*nodes, weight)
            below = _sums(up(nodes[0]), lw)[1] if d else None  # parents are the next level's nodes, in the same order
            self.lw = lw

    def top_rows(self, top: int) -> tuple[np.ndarray, ...]:
        """The parents of the top level's nodes: (key, zeros, ones, summed log P_w of the children here)."""
        k, a, b, _ = self.levels[top]
        return _sums(up(k), a, b, self.lw)


def predict(levels: dict[int, tuple[np.ndarray, ...]], grams: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte after its context."""
    context, byte = grams >> 8, grams & 255
    out = np.zeros(len(grams))
    for j in range(8):
        node, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
        p, seen = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for d in range(DEPTH, -1, -1):
            keys, a, b, weight = levels[d]
            if not len(keys):
                continue
            want = ((context >> (8 * (DEPTH - d))) << 8) | node
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            own = (np.where(bit == 1, b[at], a[at]) + 0.5) / (a[at] + b[at] + 1)
            p = np.where(hit, np.where(seen, weight[at] * own + (1 - weight[at]) * p, own), p)
            seen |= hit
        out += np.log10(p)
    return out


# ---------------------------------------------------------------- texts


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, number of each document, word hashes, number of each document)."""
    n = len(offsets) - 1
    low = _LOWER[data]
    starts, ends, doc = word_spans(low, offsets)
    size = ends - starts
    hashes = span_hashes(low, starts, ends, 1)[0] >> np.uint64(2)
    words = np.bincount(doc, minlength=n)
    length = np.bincount(doc, weights=size + 1, minlength=n).astype(np.int64)
    length = np.maximum(length, 1)
    # Each document after DEPTH + 2 end symbols, so that eight bytes can be read at once.
    lead = DEPTH + 2
    begin = np.cumsum(length + lead) - length
    body = np.full(int((length + lead).sum()), END, np.uint8)
    at = begin[doc] + (np.cumsum(size + 1) - (size + 1)) - (np.cumsum(length * (words > 0)) - length * (words > 0))[doc]
    where = C.ragged_index(at, size + 1)
    body[where] = GAP
    body[C.ragged_index(at, size)] = C.ragged(low, starts, size)
    body[begin + length - 1] = END
    eight = np.ndarray((len(body) - 7,), "<u8", body, 0, (1,))
    own = C.ragged_index(begin - 7, length)
    x = eight[own]
    return (((x >> np.uint64(16)) & np.uint64((1 << 40) - 1)) << np.uint64(8) | (x >> np.uint64(56))).astype(np.int64), length, hashes.astype(np.int64), words


def held_out(ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], bool)


def _groups(rows: Iterable[tuple]) -> Iterator[tuple[int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Per group (rows come in the order of groups) its documents: (keys, bytes, offsets), a chunk at a time."""

    def chunks(own: Iterable[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for row in own:
            keys, offsets, body = C.opened(row)
            data = np.frombuffer(body, np.uint8)
            for i, j in C.slices(offsets, CHUNK):
                yield keys[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]

    for group, own in groupby(rows, key=lambda row: row[-1]):
        yield group, chunks(own)


def _tallied(parts: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    k = np.sort((keys << 1) | train)
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(k)))
    k = k[first]
    parts.append((k >> 1, np.where(k & 1, size, 0)))
    if len(parts) >= 8:
        parts = [_sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
    return parts


def ctw_score(docs: DataFrame) -> DataFrame:
    """Score every whole text by a model of the documents whose crc32(doc_id as text) mod 10 is not 0.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (those seen
    in training), train_tokens, base_score (unigram, add 0.1), score (log10
    probability of the text) and bits_per_byte per row.

    Null text is empty and has the end as its only token.  A null doc_id counts
    as the empty text in the checksum.  Rows may repeat; each is a document.  An
    empty table gives an empty result; without any training document every
    prediction is even.
    """
    spark = docs.sparkSession
    base = C.keyed(docs)
    n = C.parts_for(docs)
    same = "__annalist_before" not in base._jdf.queryExecution().analyzed().toString()
    # Where keys had to be made, the checksum's remainder travels as the key's lowest digit.
    marked = base.withColumn("key", F.col("key") * 10 + F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10))) if not same else base

    def out_of(keys: np.ndarray) -> np.ndarray:
        return held_out(keys.tolist()) if same else keys % 10 == 0

    def tally(by: dict) -> Iterator[pa.RecordBatch]:
        for group, chunks in _groups(by.get(C.TEXT, [])):
            grams: list[tuple[np.ndarray, np.ndarray]] = []
            words: list[tuple[np.ndarray, np.ndarray]] = []
            ends = tokens = 0
            for keys, data, offsets in chunks:
                train = ~out_of(keys)
                g, length, h, count = sequences(data, offsets)
                grams = _tallied(grams, g, np.repeat(train, length).astype(np.int64))
                words = _tallied(words, h, np.repeat(train, count).astype(np.int64))
                ends += int(train.sum())
                tokens += int(count[train].sum())
            for kind, parts in ((GRAMS, grams), (WORDS, words)):
                k, c = _sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                dest = C.dest_of(k >> 32 if kind == GRAMS else k, n)
                yield C.packed(dest, [k, c.astype(np.uint32), np.full(len(k), group, np.int32)], kind)
            yield C.packed(C.dest_of(np.array([group]), n), [np.array([tokens]), np.array([ends]), np.array([0])], STAT)

    asked = C.meet(C.text_rows(marked, n), n, tally, C.PACKED)

    def gather(by: dict) -> Iterator[pa.RecordBatch]:
        for row in by.get(STAT, []):
            yield C.packed_rows(np.array([row[-1]]), STAT, [pa.array([c], pa.binary()) for c in row[:3]])
        if rows := by.get(WORDS):
            k, c, group = (C.column(rows, i, t) for i, t in enumerate((np.int64, np.uint32, np.int32)))
            uniq, total = _sums(k, c.astype(np.int64))
            yield C.packed_rows(np.array([0]), STAT, [pa.array([x], pa.binary()) for x in (np.int64(0).tobytes(), np.int64(0).tobytes(), np.int64((total > 0).sum()).tobytes())])
            yield C.packed(group, [k, total[np.searchsorted(uniq, k)]], COUNTS)
        if rows := by.get(GRAMS):
            k, c, group = (C.column(rows, i, t) for i, t in enumerate((np.int64, np.uint32, np.int32)))
            uniq, total = _sums(k, c.astype(np.int64))
            dest = C.dest_of(uniq >> 32, n)
            yield C.packed(dest, [uniq, total], TREE)
            yield C.packed(C.dest_of(k >> 32, n), [k, group], ASKED)
            if (total > 0).any():
                yield C.packed_rows(dest[:1], TOP, [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in Tree(uniq, total, 2).top_rows(2)])

    table, _ = C.stored(C.meet(asked, n, gather, C.PACKED), "counts")
    none = (np.zeros(0, np.int64), *(np.zeros(0) for _ in range(3)))

    def summed(tops: Iterable[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        total = none
        for part in tops:
            total = _sums(*(np.concatenate([x, y]) for x, y in zip(total, part, strict=True)))
        return total

    def top_of(row) -> tuple[np.ndarray, ...]:
        return (np.frombuffer(row[0], np.int64), *(np.frombuffer(row[i], np.float64) for i in range(1, 4)))

    def combine(by: dict) -> Iterator[pa.RecordBatch]:
        if STAT in by:
            yield C.packed_rows(np.array([0]), STAT, [pa.array([C.column(by[STAT], i, np.int64).sum(keepdims=True).tobytes()], pa.binary()) for i in range(3)])
        if TOP in by:
            yield C.packed_rows(np.array([0]), TOP, [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in summed(top_of(row) for row in by[TOP])])

    # At most 65,280 nodes (2 MB) come from a bucket's task; a few tasks sum them before the driver does.
    heads = C.meet(table.where(F.col("kind").isin(STAT, TOP)).withColumn("dest", F.pmod("dest", F.lit(HEADS))), HEADS, combine, C.PACKED).select("kind", "c0", "c1", "c2", "c3").collect()
    n_words, ends, distinct = (sum(int(np.frombuffer(r[1 + i], np.int64)[0]) for r in heads if r["kind"] == STAT) for i in range(3))
    train_tokens, vocabulary = n_words + ends, distinct + (ends > 0)
    one = summed(top_of(r[1:]) for r in heads if r["kind"] == TOP)
    lw, weight = weigh(one[:3], one[3])
    zero = _sums(up(one[0]), one[1], one[2], lw)
    head = spark.sparkContext.broadcast({1: (*one[:3], weight), 0: (*zero[:3], weigh(zero[:3], zero[3])[1])})

    def answer(by: dict) -> Iterator[pa.RecordBatch]:
        if not by.get(ASKED):
            return
        grams, total = C.column(by.get(TREE, []), 0, np.int64), C.column(by.get(TREE, []), 1, np.int64)
        order = np.argsort(grams)
        grams, total = grams[order], total[order]
        levels = Tree(grams, total, 2).levels | head.value
        lengths = predict(levels, grams)
        k, group = C.column(by[ASKED], 0, np.int64), C.column(by[ASKED], 1, np.int32)
        yield C.packed(group, [k, lengths[np.searchsorted(grams, k)]], LENGTHS)

    lengths = C.meet(table.where(F.col("kind").isin(TREE, ASKED)), n, answer, C.PACKED)
    replies = lengths.unionByName(table.where(F.col("kind") == COUNTS))
    floor = math.log10(train_tokens + 0.1 * (vocabulary + 1)) if train_tokens + vocabulary else math.log10(0.1)
    end_score = math.log10(ends + 0.1)

    def score(by: dict) -> Iterator[pa.RecordBatch]:
        tables = {kind: by.pop(kind).by_dest() if kind in by else {} for kind in (LENGTHS, COUNTS)}
        for group, chunks in _groups(by.get(C.TEXT, [])):
            lengths_, counts_ = (tables[kind].pop(group, []) for kind in (LENGTHS, COUNTS))
            gram_index, gram_len = pd.Index(C.column(lengths_, 0, np.int64)), C.column(lengths_, 1, np.float64)
            word_index, word_count = pd.Index(C.column(counts_, 0, np.int64)), C.column(counts_, 1, np.int64)
            word_score = np.log10(word_count + 0.1)
            for keys, data, offsets in chunks:
                g, length, h, count = sequences(data, offsets)
                at = gram_index.get_indexer(g)
                score_ = np.add.reduceat(gram_len[at], np.cumsum(length) - length)
                at = word_index.get_indexer(h)
                doc = np.repeat(np.arange(len(keys)), count)
                known = np.bincount(doc, weights=word_count[at] > 0, minlength=len(keys)).astype(np.int64) + (ends > 0)
                unigram = np.bincount(doc, weights=word_score[at], minlength=len(keys)) + end_score - (count + 1) * floor
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(out_of(keys)), pa.array(count + 1, pa.int64()), pa.array(known), pa.array(np.full(len(keys), train_tokens)), pa.array(unigram), pa.array(score_), pa.array(-score_ * math.log2(10) / length)],
                    ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                )

    out = C.meet(C.text_rows(marked, n).unionByName(replies), n, score, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return C.with_ids(out if same else out.withColumn("key", F.expr("key div 10")), base)
