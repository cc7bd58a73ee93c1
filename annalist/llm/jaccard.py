"""Near-duplicate texts: MinHash bands find candidates, whole shingle sets decide.

1. Every text becomes its set of five-word shingles (A-Z lower-cased; a shorter
   text is one shingle), a MinHash signature and a hash of the whole set.
2. Texts with the same set are copies; their smallest row stands for them.
3. ``bands`` hashes of ``rows`` signature values each: with 32 and 8, a pair of
   similarity 0.8 shares a band with probability 0.997, one of 0.9 with 1 - 1e-8.
   ``bands_for`` finds the counts for another threshold or recall.
   Rows are shuffled on band hashes; a band's members form a star around its
   smallest one, and the stars' components are the candidate groups.
4. Whole shingle sets are sent to where they are compared: to their group, or,
   where a group is large and mostly chained by chance, to each of its members'
   band buckets, whichever sends less; in a bucket a pair counts if no earlier
   band holds it.  A group or bucket of more than ``block`` texts is dealt into
   blocks and each pair of blocks is a task's unit, so no task sees an unbounded
   group.  Shared shingles of all pairs in a unit are counted by multiplying
   incidence matrices, and compared exactly.
   What leaves a unit is a link count per text and a spanning forest, never the
   pairs.
5. Linked texts form classes; a class is named by its smallest doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import common as C
from annalist.llm.components import components
from annalist.llm.lines import _LOWER, _SPACE
from annalist.llm.spans import span_hashes

CHUNK = 1 << 20
MEMBER, SET = 1, 2
_STEP = np.uint64(0x9FB21C651E98DF25)


def bands_for(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective split of at most ``most`` hashes that finds a pair at ``threshold`` with this probability."""
    for rows in range(16, 0, -1):
        miss = 1 - threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(miss)) if miss < 1 else most + 1
        if bands * rows <= most:
            return most // rows, rows
    return most, 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the runs of bytes other than ASCII white space, within documents."""
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = solid[edges]
    stop[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of each document, in order, and their number."""
    n = len(offsets) - 1
    starts, ends, doc = word_spans(data, offsets)
    (words,) = span_hashes(_LOWER[data], starts, ends, 1)
    counts = np.bincount(doc, minlength=n)
    take = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = C.ragged_index(first, take)
    short = np.repeat(counts < width, take)
    h = words[at].copy()
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for i in range(1, width):
        part = padded[at + i]
        if short.any():
            part = np.where(short & (i >= np.repeat(counts, take)), np.uint64(1), part)
        h = h * _STEP + part
    owner = np.repeat(np.arange(n), take).astype(np.uint64)
    both = np.sort((owner << np.uint64(48)) | (C.mix64(h) >> np.uint64(16)))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both & np.uint64((1 << 48) - 1), np.bincount((both >> np.uint64(48)).astype(np.int64), minlength=n)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def signatures(sets: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash per band of the MinHash signature of each set that is not empty."""
    some = counts > 0
    first = (np.cumsum(counts) - counts)[some]
    out = np.zeros((int(some.sum()), bands), np.uint64)
    if not len(first):
        return out
    x = (sets ^ (sets >> np.uint64(20))).astype(np.uint32)
    a, b = _family(bands * rows)
    for band in range(bands):
        h = np.full(len(first), band + 1, np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            h = C.mix64(h * _STEP + np.minimum.reduceat((x ^ b[i]) * a[i], first))
        out[:, band] = h
    return out


def _slices(keys: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in C.slices(offsets, CHUNK):
        for a in range(i, j, 1 << 15):
            yield a, min(j, a + (1 << 15))


def signed(base: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """key, n (shingles), set hash (s1, s2) and bands of every row of (key, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = C.text_buffers(batch.column(1))
            for i, j in _slices(keys, offsets):
                sets, n = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                upto = np.concatenate([[0], np.cumsum(n)])
                s1, s2 = (np.diff(np.concatenate([[np.uint64(0)], np.cumsum(C.mix64(sets * x))])[upto]).view(np.int64) for x in (_STEP, np.uint64(3)))
                full = np.zeros((j - i, bands), np.int64)
                full[n > 0] = signatures(sets, n, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * bands, pa.int32()), pa.array(full.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), lists], ["key", "n", "s1", "s2", "bands"])

    return C.in_arrow(base.select("key", "text"), scan, "key long, n long, s1 long, s2 long, bands array<long>")


def _shared(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of common elements of every pair of sets, given one after the other."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(rows, kind="stable")
    s, owner = rows[order], owner[order]
    new = np.append(True, s[1:] != s[:-1])
    feature = np.cumsum(new) - 1
    df = np.bincount(feature)
    keep = df[feature] > 1
    owner, feature = owner[keep], feature[keep]
    kind = np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64  # exact up to here
    out = np.zeros((n, n), kind)
    if not len(owner):
        return out
    feature = np.cumsum(np.append(True, feature[1:] != feature[:-1])) - 1
    width = max(256, (16 << 20) // (4 * n))
    cuts = np.searchsorted(feature, np.arange(0, int(feature[-1]) + 1 + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            m = np.zeros((n, min(width, int(feature[-1]) + 1 - k * width)), kind)
            m[owner[a:b], feature[a:b] - k * width] = 1
            out += m @ m.T
    return out


def _roots(adjacent: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches."""
    n = len(adjacent)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(adjacent[front].any(0) & (root < 0))
            root[front] = i
    return root


def candidate_units(sets: DataFrame, block: int) -> DataFrame:
    """rep, unit, blocks and band: where each set that has candidates is compared with them.

    A unit is a group of sets that bands link (band -1), or the bucket of a band
    where the buckets of a large group take fewer copies of its sets than pairs
    of the group's blocks would.
    """
    dealt = sets.select("rep", F.posexplode("bands").alias("band", "h")).select("rep", "band", F.xxhash64("band", "h").alias("bucket"))
    stars = dealt.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1")
    members, _ = C.stored(dealt.join(stars, "bucket"), "members")
    edges = members.where("rep <> centre").select(F.col("rep").alias("u"), F.col("centre").alias("v"))
    groups, _ = C.stored(components(edges), "groups")
    size = groups.groupBy("root").agg(F.count("*").alias("size"))
    large = size.where(F.col("size") > block)
    own = groups.join(size, "root").select(F.col("node").alias("rep"), F.col("root").alias("unit"), F.ceil(F.col("size") / block).alias("blocks"), F.lit(-1).cast("long").alias("band"))
    if large.isEmpty():
        return own
    copies = members.select("rep", F.ceil(F.col("members") / block).alias("n")).groupBy("rep").agg(F.sum("n").alias("n"))
    cost = copies.join(groups.join(large, "root"), copies["rep"] == groups["node"]).groupBy("root", "size").agg(F.sum("n").alias("n"))
    apart, _ = C.stored(cost.where(F.col("n") < F.col("size") * F.ceil(F.col("size") / block)).select("root").join(groups, "root").select(F.col("node").alias("rep")), "apart")
    buckets = members.join(apart, "rep", "left_semi").select("rep", F.col("bucket").alias("unit"), F.ceil(F.col("members") / block).alias("blocks"), F.col("band").cast("long").alias("band"))
    return own.join(apart, "rep", "left_anti").unionByName(buckets)


def near_duplicates(base: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.995, block: int = 1024) -> DataFrame:
    """key, class_key, n_copies and n_links of every row of ``keyed`` documents; see ``jaccard_join``."""
    spark, n = base.sparkSession, C.parts_for(base)
    bands, rows = bands_for(threshold, recall)
    share = Fraction(threshold).limit_denominator(1000)
    table, _ = C.stored(signed(base, width, bands, rows), "signatures")
    sets = table.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("key", "bands")).alias("low"), F.count("*").alias("n_copies"))
    sets, _ = C.stored(sets.select("s1", "s2", "n", F.col("low.key").alias("rep"), F.col("low.bands").alias("bands"), "n_copies"), "sets")

    units = candidate_units(sets, block)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, unit, blocks, band = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            yield C.packed(C.dest_of(node, n), [node, unit, blocks, band], MEMBER)

    def send(by: dict) -> Iterator[pa.RecordBatch]:
        told_ = by.pop(MEMBER, [])
        key, unit_of, blocks, band_of = (C.column(told_, i, np.int64) for i in range(4))
        order = np.argsort(key, kind="stable")
        key, unit_of, blocks, band_of = key[order], unit_of[order], blocks[order], band_of[order]
        for row in by.get(C.TEXT, []):
            keys, offsets, body = C.opened(row)
            first, last = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
            own = np.flatnonzero(last > first)
            if not len(own):
                continue
            whole = np.frombuffer(body, np.uint8)
            cut = np.concatenate([[0], np.cumsum(offsets[own + 1] - offsets[own])])
            data = C.ragged(whole, offsets[own], offsets[own + 1] - offsets[own])
            for i, j in _slices(keys[own], cut):
                found, size = shingles(data[cut[i] : cut[j]], cut[i : j + 1] - cut[i], width)
                k, count = keys[own[i:j]], (last - first)[own[i:j]]
                at = C.ragged_index(first[own[i:j]], count)
                doc = np.repeat(np.arange(j - i), count)
                # Behind its shingles a set that goes to buckets has its bands.
                banded = np.zeros(j - i, bool)
                banded[doc] = band_of[at] >= 0
                ends = np.cumsum(size)
                if banded.any():
                    hashes = signatures(found, size, bands, rows)[np.cumsum(size > 0)[banded] - 1]
                    found = np.insert(found, np.repeat(ends[banded], bands), hashes.reshape(-1))
                whole_size = size + bands * banded
                ends = np.cumsum(whole_size)
                mine = (C.mix64(k[doc].view(np.uint64)) % blocks[at].view(np.uint64)).astype(np.int64)
                # One copy for each block that the own one is paired with, itself included.
                copies = np.repeat(np.arange(len(at)), blocks[at])
                other = C.ragged_index(np.zeros(len(at), np.int64), blocks[at])
                lo, hi = np.minimum(mine[copies], other), np.maximum(mine[copies], other)
                d, at, mine = doc[copies], at[copies], mine[copies]
                unit = C.mix64(unit_of[at].view(np.uint64) + C.mix64((lo * (1 << 31) + hi + (band_of[at] + 1 << 56)).view(np.uint64)))
                dest = C.dest_of(unit.view(np.int64), n)
                order = np.argsort(dest, kind="stable")
                dest, d, unit, lo, hi, at, mine = (x[order] for x in (dest, d, unit, lo, hi, at, mine))
                # Of a set without a band here, the bands stay behind.
                take = np.where(band_of[at] >= 0, whole_size[d], size[d])
                cuts = np.append(np.flatnonzero(np.diff(dest)) + 1, len(dest))
                flags = (band_of[at] + 1) * 2 + ((blocks[at] > 1) | (band_of[at] >= 0))
                cells = [C._cells(x, cuts) for x in (unit, k[d], mine * 2 + (lo == hi), size[d], flags.astype(np.int16))]
                cells.append(C._cells(C.ragged(found, (ends - whole_size)[d], take), np.cumsum(take)[cuts - 1]))
                yield C.packed_rows(dest[np.concatenate([[0], cuts[:-1]])], SET, cells)

    def verify(by: dict) -> Iterator[pa.RecordBatch]:
        given = by.pop(SET)
        unit, key, side, size, flags = (C.column(given, i, t) for i, t in enumerate((np.uint64, np.int64, np.int64, np.int64, np.int16)))
        data = C.column(given, 5, np.uint64)
        del given
        many, band = flags & 1, (flags >> 1).astype(np.int64) - 1
        begin = np.cumsum(size + bands * (band >= 0)) - (size + bands * (band >= 0))
        order = np.lexsort((key, unit))
        cuts = np.append(np.flatnonzero(np.append(True, unit[order][1:] != unit[order][:-1])), len(order))
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            if len(own) < 2:
                continue
            common = _shared(C.ragged(data, begin[own], size[own]), size[own]).astype(np.int64)
            total = size[own][:, None] + size[own][None, :]
            near = common * (share.numerator + share.denominator) >= share.numerator * total
            np.fill_diagonal(near, False)
            if not (side[own] & 1).all():  # a unit of two blocks: pairs within one are another unit's
                near &= (side[own] >> 1)[:, None] != (side[own] >> 1)[None, :]
            if band[own[0]] > 0:  # a pair that shares an earlier band is that bucket's
                hashes = C.ragged(data, begin[own] + size[own], np.full(len(own), bands)).reshape(len(own), bands)
                for h in hashes[:, : band[own[0]]].T:
                    near &= h[:, None] != h[None, :]
            links = near.sum(1)
            hit = np.flatnonzero(links)
            if len(hit):
                root = _roots(near)
                out.append((key[own[hit]], links[hit], key[own[root[hit]]], many[own[hit]]))
        if out:
            k, links, root, m = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(links.astype(np.int64)), pa.array(root), pa.array(m > 0)], ["rep", "links", "root", "many"])

    told = C.in_arrow(units, tell, C.PACKED)
    sent = C.meet(C.text_rows(base, n).unionByName(told), n, send, C.PACKED)
    found, _ = C.stored(C.meet(sent, n, verify, "rep long, links long, root long, many boolean"), "links")
    one = found.where("not many").select("rep", "links", "root")
    many = found.where("many")
    if many.isEmpty():
        classes = one
    else:
        joined = components(many.select(F.col("rep").alias("u"), F.col("root").alias("v")))
        classes = one.unionByName(many.groupBy("rep").agg(F.sum("links").alias("links")).join(joined.withColumnRenamed("node", "rep"), "rep").select("rep", "links", "root"))
    named = sets.join(classes, "rep", "left").select("s1", "s2", "n", "n_copies", F.coalesce("root", "rep").alias("class_key"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    out = table.select("key", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return out.select("key", F.coalesce("class_key", "key").alias("class_key"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.995) -> DataFrame:
    """doc_id, class_id, n_copies and n_links per row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of
    ``width``-word shingles is at least ``threshold``; n_links is the number of
    other shingle sets that a row's set is linked to, n_copies the number of rows
    with its very set, and class_id the smallest doc_id that links and copies
    lead to.  A text with fewer words is one shingle; a text without words (null,
    empty) is linked to nothing.  Rows that share a doc_id are documents of their
    own; rows with a null doc_id come last and can be named by null.  An empty
    table gives an empty result.
    """
    base = C.keyed(docs)
    out = near_duplicates(base, threshold, width, recall)
    if "__annalist_before" not in base._jdf.queryExecution().analyzed().toString():
        return out.select(F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"), "n_copies", "n_links")
    ids = base.select("key", "doc_id")
    named = out.join(ids, "key").join(ids.select(F.col("key").alias("class_key"), F.col("doc_id").alias("class_id")), "class_key")
    return named.select("doc_id", "class_id", "n_copies", "n_links")
