"""Packing token sequences into windows by best-fit decreasing.

A task encodes its documents, cuts overlong ones into full windows first, and
then deals the pieces in the order of falling length to the open window that
they leave the least room in.  A segment tree over the remaining capacities
finds it.  Nothing is shuffled; a task holds ``group_tokens`` ids at a time, so a
hot source or a very long document changes neither memory nor the split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from annalist.llm import common as C
from annalist.llm.bpe import _texts, compiled, encoder_of, send

OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Capacities:
    """Open windows by remaining capacity; a node of the tree counts the windows below it."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with at least this capacity, removed from the tree: (capacity, window)."""
        count, i = self.count, least + self.size
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        at = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return at, self.open[at].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of every piece, none longer than a window, and the number of windows."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = Capacities(window), 0
    for i in order.tolist():
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found = (window, n)
            n += 1
        capacity, w = found
        where[i], offset[i] = w, window - capacity
        if capacity > length:
            tree.add(capacity - length, w)
    return where, offset, n


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, group_tokens: int = 4 << 20) -> DataFrame:
    """Pack every document's ids, then ``end_id``, into sequences of at most ``window`` ids.

    Returns a row per piece: doc_id, start (ids of its document before it),
    length, ids (little-endian unsigned 32-bit numbers), doc_tokens, sequence_id
    and offset in the sequence, gapless from 0.  Null text is empty: its only id
    is ``end_id``.  A null doc_id stays null.  Rows may repeat; each is packed by itself.  An empty table
    gives an empty result.
    """
    tables = send(docs.sparkSession, compiled(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tables, show=False)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> tuple[list[pa.RecordBatch], int]:
            docs_, ids, n = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            pieces = -(-n // window)
            doc = np.repeat(np.arange(len(n)), pieces)
            start = C.ragged_index(np.zeros(len(n), np.int64), pieces) * window
            length = np.minimum(window, n[doc] - start)
            where, offset, used = best_fit_decreasing(length, window)
            out = []
            upto = np.cumsum(length)
            for i in range(0, len(doc), 4096):
                j = min(i + 4096, len(doc))
                at = int(upto[i] - length[i])
                cells = C._cells(ids[at : int(upto[j - 1])].astype("<u4"), upto[i:j] - at)
                out.append(pa.RecordBatch.from_arrays([docs_.take(pa.array(doc[i:j])), pa.array(start[i:j]), pa.array(length[i:j]), cells, pa.array(n[doc[i:j]]), pa.array(sequence + where[i:j]), pa.array(offset[i:j])], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]))
            return out, used

        for batch in batches:
            data, offsets = C.text_buffers(batch.column(1))
            for i, j in C.slices(offsets, 2 << 20):
                ids, n = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, np.cumsum(n), end_id)
                held.append((batch.column(0).slice(i, j - i), ids, n + 1))
                size += len(ids)
                if size >= group_tokens:
                    out, used = flush()
                    yield from out
                    sequence += used
                    held, size = [], 0
        if held:
            yield from flush()[0]

    return C.in_arrow(_texts(docs), run, OUT, keep=True)
