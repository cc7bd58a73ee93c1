"""Repeated passages, found by sorting suffixes one bucket at a time.

A byte string of ``length`` bytes (100) is repeated where it also starts earlier
(smaller document, or the same document and an earlier start).  Sorting the
suffixes of all text would move every byte a hundred times, so the suffixes are
dealt into buckets first, and only those that can have a partner are sorted:

1. *Anchors.*  Of the hashes of the 20-byte strings inside a window of
   ``length`` bytes the smallest one (leftmost on a tie) is the window's anchor.
   It depends on the window's bytes only, so equal windows have equal anchors:
   the anchor is the bucket of the suffix that starts the window.  Windows next
   to each other mostly share an anchor; such a run is a *segment*, described by
   its anchor's hash, a 128-bit hash of its bytes and its place.
2. *Copies.*  Segments alike in all hashes hold the same windows.  All but the
   first are copies; they are collapsed in the task that reads them and again in
   the bucket, so a bucket holds a row per reading task and distinct segment
   however many copies there are.
3. *Suffix sort.*  Buckets left with two or more distinct segments get the bytes
   of those segments.  There the suffixes are sorted blockwise: ranks of the
   suffixes that start at a difference cover modulo 32 are computed once for
   the bucket's text; then one block of suffixes at a time (a range of leading
   bytes) is sorted by 32 bytes, and longer ties are resolved by the ranks of the
   cover places that lie equally far behind both suffixes.  The first suffix of
   each class of equal windows is new, the others repeat it.
   A bucket with more than ``hot_segments`` distinct segments is split further
   before its bytes are moved: each of its windows travels by itself, dealt by
   a hash of its own bytes, so equal windows still meet and are still sorted.
4. *Claims.*  Only new windows are reported to their documents; every other
   window of a document is repeated, and the bytes it covers are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import common as C
from annalist.llm.spans import eights, span_hashes

GRAM = 20
CHUNK = 1 << 20
PERIOD = 32
_ROOT = 6
#: A difference cover modulo PERIOD: small steps, and every sixth place.
COVER = np.array(sorted({*range(_ROOT), *range(0, PERIOD, _ROOT)}))
_SHIFT = np.zeros((PERIOD, PERIOD), np.int64)
for _i in range(PERIOD):
    for _j in range(PERIOD):
        _SHIFT[_i, _j] = min(d for d in range(PERIOD) if (_i + d) % PERIOD in COVER and (_j + d) % PERIOD in COVER)

CLAIM, REQUEST, SEGMENT = 1, 2, 3
OUT = "key long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,length:long>>, kept binary"


# ---------------------------------------------------------------- anchors and segments


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place on; it only deals windows to buckets."""
    words = eights(data)[: len(data) - 8 + 1]
    n = len(data) - GRAM + 1
    x = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    x ^= words[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    x += words[GRAM - 8 : n + GRAM - 8] * np.uint64(0xD6E8FEB86659FD93)
    return C.mix64(x)


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of a buffer of whole documents that end at ``ends``: (first start, number of starts, anchor's hash, two hashes)."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    grams = _grams(data)
    bits = max(1, int(len(data)).bit_length())
    low = np.uint64((1 << bits) - 1)
    m = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    anchor = (m[:n] & low).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(ends)), ends - starts)[:n]
    fits = np.arange(n) + length <= ends[owner]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (fits[1:] != fits[:-1])
    lo = np.flatnonzero(new)
    count = np.diff(np.append(lo, n))
    ok = fits[lo]
    lo, count = lo[ok], count[ok]
    at = anchor[lo]
    h2, h3 = span_hashes(data, lo, lo + count + length - 1)
    return lo, count, grams[at], C.mix64(h2 + C.mix64(((at - lo) * 4096 + count).view(np.uint64))), h3


def _sections(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Buffers of about CHUNK bytes: (bytes, ends, key and place of each piece); long documents are cut, overlapping by length - 1."""
    for i, j in C.slices(offsets, CHUNK):
        if offsets[j] - offsets[i] <= CHUNK:
            yield data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i], keys[i:j], np.zeros(j - i, np.int64)
            continue
        for at in range(int(offsets[i]), int(offsets[j]), CHUNK):
            piece = data[at : min(at + CHUNK + length - 1, int(offsets[j]))]
            yield piece, np.array([len(piece)]), keys[i:j], np.array([at - offsets[i]])


def _first_of(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, key: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each (h1, h2, h3), ordered by h1, and the number of such with each one's h1."""
    order = np.lexsort((lo, key, h3, h2, h1))
    a, b, c = h1[order], h2[order], h3[order]
    if not len(order):
        return order, order
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
    order = order[first]
    a = h1[order]
    cuts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
    sizes = np.diff(cuts)
    return order, np.repeat(sizes, sizes)


def anchor_rows(docs: DataFrame, n: int, length: int) -> DataFrame:
    """Every segment of (key, text), less the copies within a task's reach, dealt by its anchor's hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h1, h2, h3, key, lo, count = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keep, _ = _first_of(h1, h2, h3, key, lo)
            keep = keep[np.lexsort((lo[keep], key[keep]))]
            yield C.packed(C.dest_of(h1[keep].view(np.int64), n), [h1[keep], h2[keep], h3[keep], key[keep], lo[keep].astype(np.int32), count[keep].astype(np.int16)], SEGMENT)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = C.text_buffers(batch.column(1))
            for piece, ends, own, place in _sections(data, offsets, keys, length):
                lo, count, h1, h2, h3 = segments(piece, ends, length)
                doc = np.searchsorted(ends, lo, "right")
                begin = np.concatenate([[0], ends[:-1]])
                held.append((h1, h2, h3, own[doc], lo - begin[doc] + place[doc], count))
                size += len(lo)
                if size >= 1 << 19:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return C.in_arrow(docs.select("key", "text"), scan, C.PACKED)


# ---------------------------------------------------------------- difference-cover suffix sort


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number that sorts as they do; text is padded by eight."""
    return np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))


def _classes(words: np.ndarray, at: np.ndarray, depth: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sort places by ``depth`` bytes, within ``group`` if given: (order, class of each in that order, rising)."""
    n = len(at)
    cls = np.zeros(n, np.int64) if group is None else group.astype(np.int64)
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    steps = sorted({*range(0, depth - 7, 8), depth - 8})
    for step in steps:
        same = np.append(cls[1:] == cls[:-1], False)
        tied = same | np.append(False, same[:-1])
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        w = words[at[order[rows]] + step].astype(np.uint64)
        by = np.lexsort((w, cls[rows]))
        order[rows] = order[rows[by]]
        w, c = w[by], cls[rows]
        cut = np.zeros(n, np.int64)
        cut[rows[1:]] = (c[1:] == c[:-1]) & (w[1:] != w[:-1])
        jump = np.append(0, (cls[1:] != cls[:-1]).astype(np.int64))
        cls = np.cumsum(jump | cut)
    if n:
        cls = np.cumsum(np.append(0, (cls[1:] != cls[:-1]).astype(np.int64)))
    return order, cls


def sort_windows(text: np.ndarray, at: np.ndarray, length: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sort the suffixes at ``at`` by their first ``length`` bytes, a block at a time.

    Yields (indices into ``at``, class) per block, in order; equal classes are
    equal windows.  ``text`` needs ``length`` bytes from every one of ``at`` on.
    ``length`` is at least 2 * PERIOD + 8.
    """
    if not len(at):
        return
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words, depth = _words(padded), length - PERIOD
    sample = np.flatnonzero(np.isin(np.arange(max(0, len(text) - depth + 1)) % PERIOD, COVER))
    rank = np.full(len(text) + 1, -1, np.int64)
    order, cls = _classes(words, sample, depth)
    rank[sample[order]] = cls
    lead = words[at].astype(np.uint64)
    by = np.argsort(lead, kind="stable")
    lo = 0
    while lo < len(by):
        hi = min(lo + block, len(by))
        hi = int(np.searchsorted(lead[by], lead[by[hi - 1]], "right")) if hi < len(by) else hi
        own = by[lo:hi]
        order, cls = _classes(words, at[own], PERIOD)
        own = own[order]
        # The last bytes, which the ranks of near cover places do not reach.
        tail = np.zeros(len(own), np.int64)
        same = np.append(cls[1:] == cls[:-1], False)
        tied = np.flatnonzero(same | np.append(False, same[:-1]))
        order, t = _classes(words, at[own[tied]] + length - PERIOD, PERIOD)
        tail[tied[order]] = t
        yield _resolved(rank, tail, at, own, cls)
        lo = hi


def _resolved(rank: np.ndarray, tail: np.ndarray, at: np.ndarray, own: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split classes of equal first PERIOD bytes three ways around a pivot, until none splits: (own in order, class).

    Two suffixes are compared by the ranks of the cover places equally far
    behind them and then by their last bytes: together all of their bytes.
    """
    group = np.cumsum(np.append(0, (cls[1:] != cls[:-1]).astype(np.int64)))
    n = len(own)
    same = np.append(group[1:] == group[:-1], False)
    rows = np.flatnonzero(same | np.append(False, same[:-1]))
    done = np.ones(n, bool)
    done[rows] = False
    while len(rows):
        g = group[rows]
        first = np.append(True, g[1:] != g[:-1])
        pivot = rows[np.flatnonzero(first)][np.cumsum(first) - 1]
        a, b = at[own[rows]], at[own[pivot]]
        shift = _SHIFT[a % PERIOD, b % PERIOD]
        side = np.sign(rank[a + shift] - rank[b + shift])
        side = np.where(side == 0, np.sign(tail[rows] - tail[pivot]), side)
        every = np.ones(n, np.int64)
        every[rows] = side + 1
        done[rows[side == 0]] = True
        key = group * 3 + every
        order = np.argsort(key, kind="stable")
        own, tail, done, key = own[order], tail[order], done[order], key[order]
        group = np.cumsum(np.append(0, (key[1:] != key[:-1]).astype(np.int64)))
        rows = np.flatnonzero(~done)
    return own, group


def new_windows(text: np.ndarray, at: np.ndarray, key: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``at`` are the first, by (key, place), of those with the same bytes."""
    new = np.zeros(len(at), bool)
    for own, cls in sort_windows(text, at, length):
        order = np.lexsort((place[own], key[own], cls))
        c = cls[order]
        new[own[order[np.append(True, c[1:] != c[:-1])]]] = True
    return new


# ---------------------------------------------------------------- buckets and documents


def _claims(key: np.ndarray, lo: np.ndarray, count: np.ndarray, n: int) -> pa.RecordBatch:
    order = np.lexsort((lo, key))
    key, lo, count = key[order], lo[order], count[order]
    return C.packed(C.dest_of(key, n), [key, lo.astype(np.int64).astype(np.int32), count.astype(np.int16)], CLAIM)


def suffix_dedup(docs: DataFrame, length: int = 100, hot_segments: int = 50_000) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier in the table.

    Returns per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans (start
    and length of each removed run, in bytes) and kept (the remaining bytes).

    Null text is empty and loses nothing, as does a text shorter than ``length``.
    Rows that share a doc_id are documents of their own, in the order of their
    text; rows with a null doc_id come after all others.  Of rows alike in both,
    one counts as the earlier.  An empty table gives an empty result.
    """
    base = C.keyed(docs)
    return C.with_ids(dedup_passages(base, length, hot_segments), base)


def dedup_passages(base: DataFrame, length: int = 100, hot_segments: int = 50_000, whole_characters: bool = False) -> DataFrame:
    """``suffix_dedup`` of ``keyed`` documents, by key; with ``whole_characters`` a character goes if any byte of it does."""
    if length < 2 * PERIOD + 8:
        raise ValueError("length must be at least 72")
    n = C.parts_for(base)

    def collapse(by: dict) -> Iterator[pa.RecordBatch]:
        rows = by.pop(SEGMENT)
        h1, h2, h3, key, lo, count = (C.column(rows, i, t) for i, t in enumerate((np.uint64, np.uint64, np.uint64, np.int64, np.int32, np.int16)))
        del rows
        first, variants = _first_of(h1, h2, h3, key, lo)
        del h2, h3
        one = first[variants == 1]
        yield _claims(key[one], lo[one], count[one], n)
        more, variants = first[variants > 1], variants[variants > 1]
        if len(more):
            yield C.packed(C.dest_of(key[more], n), [key[more], lo[more], count[more], h1[more], (variants > hot_segments).astype(np.int8)], REQUEST)

    table, _ = C.stored(C.meet(anchor_rows(base, n, length), n, collapse, C.PACKED), "anchors")
    claims, requests = table.where(F.col("kind") == CLAIM), table.where(F.col("kind") == REQUEST)

    def cut_out(by: dict) -> Iterator[pa.RecordBatch]:
        if REQUEST not in by:
            return
        rows = by.pop(REQUEST)
        key, lo, count, h1, hot = (C.column(rows, i, t) for i, t in enumerate((np.int64, np.int32, np.int16, np.uint64, np.int8)))
        order = np.lexsort((lo, key))
        key, lo, count, h1, hot = key[order], lo[order].astype(np.int64), count[order].astype(np.int64), h1[order], hot[order]
        for row in by.get(C.TEXT, []):
            keys, offsets, body = C.opened(row)
            data = np.frombuffer(body, np.uint8)
            a, b = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
            own = C.ragged_index(a, b - a)
            if not len(own):
                continue
            begin = np.repeat(offsets[:-1], b - a)
            k, at, m, h = key[own], lo[own], count[own], h1[own]
            split = hot[own] > 0
            if split.any():
                # One window each; of those equal within a chunk only the earliest goes.
                found = []
                s_k, s_b, s_at, s_m = k[split], begin[split], at[split], m[split]
                size = s_m + length - 1
                for i, j in C.slices(np.concatenate([[0], np.cumsum(size)]), 2 << 20):
                    text = C.ragged(data, s_b[i:j] + s_at[i:j], size[i:j])
                    place, own_k, own_b = C.ragged_index(s_at[i:j], s_m[i:j]), np.repeat(s_k[i:j], s_m[i:j]), np.repeat(s_b[i:j], s_m[i:j])
                    new = new_windows(text, C.ragged_index(np.cumsum(size[i:j]) - size[i:j], s_m[i:j]), own_k, place, length)
                    found.append((place[new], own_k[new], own_b[new]))
                each, own_k, own_b = (np.concatenate(x) for x in zip(*found, strict=True))
                (window,) = span_hashes(data, own_b + each, own_b + each + length, 1)
                k, begin, at = (np.concatenate([x[~split], y]) for x, y in ((k, own_k), (begin, own_b), (at, each)))
                m, h = np.concatenate([m[~split], np.ones(len(each), np.int64)]), np.concatenate([h[~split], window])
            dest = C.dest_of(h.view(np.int64), n)
            order = np.argsort(dest, kind="stable")
            k, begin, at, m, h, dest = k[order], begin[order], at[order], m[order], h[order], dest[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(dest)) + 1, [len(dest)]])
            size = m + length - 1
            body_ends = np.cumsum(size)[cuts[1:] - 1]
            cells = [C._cells(x, cuts[1:]) for x in (h, k, at.astype(np.int32), m.astype(np.int16))]
            cells.append(C._cells(C.ragged(data, begin + at, size), body_ends))
            yield C.packed_rows(dest[cuts[:-1]], SEGMENT, cells)

    texts = C.text_rows(base, n)
    cut = C.meet(texts.unionByName(requests), n, cut_out, C.PACKED)

    def sort_bucket(by: dict) -> Iterator[pa.RecordBatch]:
        rows = by.pop(SEGMENT)
        h1, key, lo, count = (C.column(rows, i, t) for i, t in enumerate((np.uint64, np.int64, np.int32, np.int16)))
        data = C.column(rows, 4, np.uint8)
        lo, count = lo.astype(np.int64), count.astype(np.int64)
        begin = np.cumsum(count + length - 1) - (count + length - 1)
        order = np.argsort(h1, kind="stable")
        size = (count + length - 1)[order]
        edges = np.append(np.flatnonzero(np.append(True, h1[order][1:] != h1[order][:-1])), len(order))
        i = 0
        while i < len(edges) - 1:
            # Whole buckets of about 4 MB at a time.
            upto = np.cumsum(size[edges[i] :])
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + np.searchsorted(upto, 4 << 20, "right"), "right")) - 1)
            own = order[edges[i] : edges[j]]
            text = C.ragged(data, begin[own], count[own] + length - 1)
            at0 = np.cumsum(count[own] + length - 1) - (count[own] + length - 1)
            at = C.ragged_index(at0, count[own])
            k, place = np.repeat(key[own], count[own]), C.ragged_index(lo[own], count[own])
            new = new_windows(text, at, k, place, length)
            k, place = k[new], place[new]
            if len(k):
                turn = np.lexsort((place, k))
                k, place = k[turn], place[turn]
                cut = np.append(True, (k[1:] != k[:-1]) | (place[1:] != place[:-1] + 1))
                run = np.diff(np.append(np.flatnonzero(cut), len(k)))
                while (run > 30_000).any():  # counts travel as 16-bit numbers
                    far = np.concatenate([np.arange(s, s + r, 30_000) for s, r in zip(np.flatnonzero(cut), run, strict=True)])
                    cut[far] = True
                    run = np.diff(np.append(np.flatnonzero(cut), len(k)))
                yield _claims(k[cut], place[cut], run, n)
            i = j

    claims = claims.unionByName(C.meet(cut, n, sort_bucket, C.PACKED))

    def remove(by: dict) -> Iterator[pa.RecordBatch]:
        rows = by.pop(CLAIM, [])
        key, lo, count = (C.column(rows, i, t) for i, t in enumerate((np.int64, np.int32, np.int16)))
        order = np.argsort(key, kind="stable")
        key, lo, count = key[order], lo[order].astype(np.int64), count[order].astype(np.int64)
        for row in by.get(C.TEXT, []):
            keys, offsets, body = C.opened(row)
            data = np.frombuffer(body, np.uint8)
            a, b = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
            for i, j in C.slices(offsets, 2 << 20):
                yield _removed(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], keys[i:j], [(lo[x:y], count[x:y]) for x, y in zip(a[i:j], b[i:j], strict=True)], length, whole_characters)

    return C.meet(texts.unionByName(claims), n, remove, OUT)


def _removed(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, claims: list, length: int, whole_characters: bool) -> pa.RecordBatch:
    size = np.diff(offsets)
    total = len(data)
    windows = np.maximum(size - length + 1, 0)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, offsets[:-1], windows > 0)
    np.add.at(edge, offsets[:-1] + windows, -(windows > 0).astype(np.int64))
    counts = np.array([len(c[0]) for c in claims], np.int64)
    if counts.sum():
        at = np.concatenate([c[0] for c in claims]) + np.repeat(offsets[:-1], counts)
        edge += np.bincount(at + np.concatenate([c[1] for c in claims]), minlength=total + 1)[: total + 1]
        edge -= np.bincount(at, minlength=total + 1)[: total + 1]
    old = np.cumsum(edge)[:total] > 0
    cover = np.zeros(total + length + 1, np.int64)
    step = np.diff(np.concatenate([[0], old.astype(np.int64), [0]]))
    begin, end = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
    # A document's windows stop short of its end, so a run never reaches into the next document.
    cover[begin] += 1
    np.add.at(cover, end + length - 1, -1)
    gone = np.cumsum(cover)[:total] > 0
    if whole_characters and total:
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        gone = (np.bincount(character, weights=gone) > 0)[character]
    before = np.concatenate([[0], np.cumsum(gone)])
    n_gone = before[offsets[1:]] - before[offsets[:-1]]
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = offsets[:-1][(size > 0)]
    first[inner] = gone[inner]
    runs = np.concatenate([[0], np.cumsum(first)])
    n_runs = runs[offsets[1:]] - runs[offsets[:-1]]
    starts = np.flatnonzero(first)
    last = gone.copy()
    last[:-1] &= ~gone[1:]
    tail = offsets[1:][size > 0] - 1
    last[tail] = gone[tail]
    stops = np.flatnonzero(last) + 1
    base = np.repeat(offsets[:-1], n_runs)
    spans = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(stops - starts, pa.int64())], ["start", "length"])
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32()), spans)
    kept = C._cells(data[~gone], np.cumsum(size - n_gone))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(size), pa.array(n_gone), pa.array(n_runs), spans, kept], ["key", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
