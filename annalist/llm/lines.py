"""Line dedup against levelled sorted runs of line hashes.

The index is a list of *runs*: Parquet tables in the shared folder, each dealt
to the same number of buckets by the 128-bit hash of a line and sorted by it
within a bucket, with the document that owns the line.  A batch of documents is
reduced to its distinct line hashes (each with the smallest document that has
it), dealt to the same buckets, and merge-anti-joined with each run: the runs
are read where they lie, neither shuffled nor sorted again.  What is left is new
and becomes a run of level 0.  ``fanout`` runs of a level are merged, bucket by
bucket, into one run of the next level, so a batch meets O(fanout *
log(batches)) runs.  Batches come in the order of doc_id, so a line is new
exactly in the smallest document that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import common as C
from annalist.llm.spans import span_hashes

CLAIM = 1
CHUNK = 1 << 20
#: Bytes of input that a batch takes, so that the number of batches follows the input's size.
BATCH_BYTES = 8 << 30
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every line; an empty document has one empty line."""
    breaks = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(offsets[1:], breaks, "right")
    n_docs = len(offsets) - 1
    ends = np.concatenate([breaks, offsets[1:]])
    owner = np.concatenate([doc_of, np.arange(n_docs)])
    order = np.lexsort((np.concatenate([np.zeros(len(breaks), np.int8), np.ones(n_docs, np.int8)]), ends, owner))
    ends, owner = ends[order], owner[order]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    starts[first] = offsets[:-1][owner[first]]
    return starts, ends, owner


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the key is long enough, two hashes of such a key) of every line."""
    solid = np.flatnonzero(~_SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    padded = np.append(solid, 0)
    lo = np.where(some, padded[np.minimum(a, len(solid))], starts)
    hi = np.where(some, padded[np.maximum(b - 1, 0)] + 1, starts)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[hi] - points[lo] >= min_chars
    h1, h2 = np.zeros((2, len(lo)), np.uint64)
    h1[long], h2[long] = span_hashes(_LOWER[data], lo[long], hi[long])
    return long, h1, h2


def _distinct(h1: np.ndarray, h2: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes with the smallest key of each."""
    order = np.lexsort((key, h2, h1))
    h1, h2, key = h1[order], h2[order], key[order]
    first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) if len(h1) else np.zeros(0, bool)
    return h1[first], h2[first], key[first]


class LineRuns:
    """A growing index of the lines seen so far: (h1, h2, key) rows in bucketed, sorted runs."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 3) -> None:
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.runs: list[tuple[int, str]] = []  # level, table
        self.paths: dict[str, str] = {}

    def add(self, rows: DataFrame) -> None:
        """Keep the lines of a batch (h1, h2, key) that no run has, as a run of their own."""
        new = rows.repartition(self.buckets, "h1", "h2").groupBy("h1", "h2").agg(F.min("key").alias("key"))
        for _, run in reversed(self.runs):
            new = new.join(self.spark.table(run).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._write(0, new)
        level = 0
        while len(own := [t for lv, t in self.runs if lv == level]) >= self.fanout:
            merged = self.spark.table(own[0])
            for run in own[1:]:  # no two runs share a line, so a full outer join is their merge
                other = self.spark.table(run).withColumnRenamed("key", "other")
                merged = merged.join(other.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("key", "other").alias("key"))
            self.runs = [(lv, t) for lv, t in self.runs if lv != level]
            level += 1
            self._write(level, merged)
            for run in own:
                self.drop(run)

    def _write(self, level: int, rows: DataFrame) -> None:
        path = C.new_path(self.spark, "run")
        run = f"annalist_run_{path[-32:]}"
        # One file a bucket, sorted: Spark may rely on that order where it reads a run.
        sorted_scan = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(sorted_scan)
        self.spark.conf.set(sorted_scan, "true")
        try:
            rows.select("h1", "h2", "key").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(run)
        finally:
            self.spark.conf.set(sorted_scan, before)
        self.runs.append((level, run))
        self.paths[run] = path

    def drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")  # forgets the table; its files are in the shared folder
        C.dropped(self.spark, self.paths.pop(run))

    def owners(self) -> DataFrame:
        """h1, h2 and key of every line seen, by its first document; the tables are forgotten, their files stay for the result."""
        out = None
        for _, run in self.runs:
            rows = self.spark.read.schema("h1 long, h2 long, key long").parquet(self.paths[run])
            out = rows if out is None else out.unionByName(rows)
            self.spark.sql(f"DROP TABLE {run}")
        self.runs = []
        return out


def line_rows(base: DataFrame, bounds: list[int], min_chars: int) -> DataFrame:
    """h1, h2, key of the lines of (key, text), less the repeats within a task's reach; ``turn``: the number of bounds that the key is not below."""
    edges = np.array(bounds, np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            # A line is known by its smallest key here, and that key's turn is its first.
            h1, h2, key = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(key), pa.array(np.searchsorted(edges, key, "right").astype(np.int32))], ["h1", "h2", "key", "turn"])

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = C.text_buffers(batch.column(1))
            for i, j in C.slices(offsets, CHUNK):
                piece = data[offsets[i] : offsets[j]]
                starts, ends, owner = line_spans(piece, offsets[i : j + 1] - offsets[i])
                long, h1, h2 = line_keys(piece, starts, ends, min_chars)
                held.append((h1[long], h2[long], keys[i:j][owner[long]]))
                size += int(long.sum())
                if size >= 1 << 18:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return C.in_arrow(base.select("key", "text"), scan, "h1 long, h2 long, key long, turn int")


def line_dedup(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """Drop every line that a document with a smaller doc_id also has.

    A line's key is the line without white space at its ends, A-Z lower-cased;
    only keys of at least ``min_chars`` code points count.  Returns doc_id,
    n_lines, n_dropped and text (the other lines, joined by \\n) per row.
    Documents come in ``batches`` ranges of doc_id: at least four, and one for
    every BATCH_BYTES of input.

    Null or empty text is one empty line.  Rows that share a doc_id are
    documents of their own, in the order of their text; rows with a null doc_id
    come after all others.  An empty table gives an empty result.
    """
    base = C.keyed(docs)
    return C.with_ids(dedup_lines(base, min_chars, batches, fanout), base)


def dedup_lines(base: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """``line_dedup`` of ``keyed`` documents, by key."""
    spark, n = base.sparkSession, C.parts_for(base)
    batches = batches or max(4, math.ceil(C.plan_bytes(base) / BATCH_BYTES))
    marks = [i / batches for i in range(1, batches)]
    at = base.select(F.percentile_approx("key", marks, 1000).alias("at")).first()["at"] if marks else []
    bounds = sorted(set(at or []))
    path = C.new_path(spark, "lines")
    line_rows(base, bounds, min_chars).write.partitionBy("turn").parquet(path)
    rows = spark.read.schema("h1 long, h2 long, key long, turn int").parquet(path)
    index = LineRuns(spark, n, fanout)
    for t in range(len(bounds) + 1):
        index.add(rows.where(F.col("turn") == t).drop("turn"))
    C.dropped(spark, path)

    def tell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for part in [*parts, None]:
            if part is not None:
                held.append(tuple(part.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
                size += part.num_rows
            if held and (part is None or size >= 1 << 20):
                h1, h2, key = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(key, kind="stable")
                yield C.packed(C.dest_of(key[order], n), [key[order], h1[order], h2[order]], CLAIM)
                held, size = [], 0

    claims = C.in_arrow(index.owners(), tell, C.PACKED)

    def keep(by: dict) -> Iterator[pa.RecordBatch]:
        claimed = by.pop(CLAIM, [])
        key, h1, h2 = (C.column(claimed, i, t) for i, t in enumerate((np.int64, np.uint64, np.uint64)))
        del claimed
        order = np.lexsort((h2, h1, key))
        key, h1, h2 = key[order], h1[order], h2[order]
        for row in by.get(C.TEXT, []):
            keys, offsets, body = C.opened(row)
            data = np.frombuffer(body, np.uint8)
            for i, j in C.slices(offsets, CHUNK):
                a, b = np.searchsorted(key, keys[i:j], "left"), np.searchsorted(key, keys[i:j], "right")
                own = C.ragged_index(a, b - a)
                yield _kept(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], keys[i:j], np.repeat(np.arange(j - i), b - a), h1[own], h2[own], min_chars)

    return C.meet(C.text_rows(base, n).unionByName(claims), n, keep, "key long, n_lines long, n_dropped long, text string")


def _kept(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, doc: np.ndarray, g1: np.ndarray, g2: np.ndarray, min_chars: int) -> pa.RecordBatch:
    """The documents without the lines that are not theirs; (doc, g1, g2): the lines that are, sorted within documents."""
    starts, ends, owner = line_spans(data, offsets)
    long, h1, h2 = line_keys(data, starts, ends, min_chars)
    # Own lines before lines: a line stays if the last own one up to it is the same.
    mine = np.concatenate([np.ones(len(doc), bool), np.zeros(int(long.sum()), bool)])
    d, x, y = np.concatenate([doc, owner[long]]), np.concatenate([g1, h1[long]]), np.concatenate([g2, h2[long]])
    order = np.lexsort((~mine, y, x, d))
    d, x, y, mine = d[order], x[order], y[order], mine[order]
    last = np.maximum.accumulate(np.where(mine, np.arange(len(order)), -1))
    stay = (last >= 0) & (d[last] == d) & (x[last] == x) & (y[last] == y)
    stays = ~long
    stays[np.flatnonzero(long)[order[~mine] - len(doc)]] = stay[~mine]
    n_docs = len(keys)
    n_lines = np.bincount(owner, minlength=n_docs)
    dropped = np.bincount(owner[~stays], minlength=n_docs)
    s, e, o = starts[stays], ends[stays], owner[stays]
    size = e - s + np.append(o[1:] == o[:-1], False) if len(o) else np.zeros(0, np.int64)
    text = C.ragged(data, s, size)
    lengths = np.bincount(o, weights=size, minlength=n_docs).astype(np.int64)
    cells = C._cells(text, np.cumsum(lengths)).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n_lines.astype(np.int64)), pa.array(dropped.astype(np.int64)), cells], ["key", "n_lines", "n_dropped", "text"])
