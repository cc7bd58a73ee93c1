"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into segments.  With each segment's mean m and deviation s
(times the root of its length), Cauchy and Schwarz give for the squared distance
of a query and a row
    |q - x|^2 >= sum over segments of (m_q - m_x)^2 + (s_q - s_x)^2,
and with |q|^2 + |x|^2 - 2 q.x for the distance an upper bound of the inner
product.  A block of rows is bounded with few segments, then with more, and only
pairs that can still reach a query's k-th best score get exact ones.
Queries go to the executors in blocks of at most ``block`` vectors; a task keeps
k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import common as C

LEVELS = (4, 16)
_NO_ID = np.iinfo(np.int64).max
_ROWS = 1024


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of ``segments`` pieces, both times the root of the piece's length: their products bound inner products."""
    n, d = x.shape
    cuts = np.linspace(0, d, min(segments, d) + 1).astype(int)
    out = np.empty((n, 2 * (len(cuts) - 1)))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        mean = x[:, a:b].mean(1)
        out[:, 2 * i] = mean * np.sqrt(b - a)
        out[:, 2 * i + 1] = np.sqrt(np.maximum(((x[:, a:b] - mean[:, None]) ** 2).sum(1), 0))
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs, exact in either way; beyond 64 bits they are cut to its ends."""
    d = q.shape[1]
    most = (float(np.abs(q).max()) if q.size else 0.0) * (float(np.abs(x).max()) if x.size else 0.0) * max(d, 1)
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    big = q.astype(object) @ x.astype(object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best rows of each query so far: by score, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.q, self.own, self.k = queries, ids, k
        n = len(queries)
        self.query, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, np.iinfo(np.int64).min)  # the k-th best score and its id
        self.least_id = np.full(n, _NO_ID)
        self.stats = {s: statistics(queries.astype(np.float64), s) for s in LEVELS}
        self.norm = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        self.pairs = self.exact = 0

    def offer(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        fits = ((score > self.least[query]) | ((score == self.least[query]) & (row < self.least_id[query]))) & (row != self.own[query])
        query, score, row = (np.concatenate(x) for x in ((self.query, query[fits]), (self.score, score[fits]), (self.row, row[fits])))
        order = np.lexsort((row, -score.astype(np.float64), query)) if np.abs(score.astype(np.float64)).max(initial=0) < 2**53 else np.lexsort((row, ~score, query))
        query, score, row = query[order], score[order], row[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = place < self.k
        self.query, self.score, self.row = query[keep], score[keep], row[keep]
        last = place[keep] == self.k - 1
        self.least[self.query[last]] = self.score[last]
        self.least_id[self.query[last]] = self.row[last]

    def look(self, x: np.ndarray, ids: np.ndarray) -> None:
        """Take a block of rows into account."""
        nq, nx = len(self.q), len(x)
        self.pairs += nq * nx
        rows = x.astype(np.float64)
        slack = 1e-9 * self.norm[:, None] * np.sqrt((rows**2).sum(1))[None, :] + 1e-6
        floor = self.least.astype(np.float64)[:, None] - slack
        alive = None
        for s in LEVELS:
            stats = statistics(rows, s)
            if alive is None or alive.mean() > 0.1:
                may = self.stats[s] @ stats.T >= floor
                alive = may if alive is None else alive & may
            else:
                a, b = np.nonzero(alive)
                may = np.einsum("ij,ij->i", self.stats[s][a], stats[b]) >= floor[a, b]
                alive = np.zeros((nq, nx), bool)
                alive[a[may], b[may]] = True
        a, b = np.nonzero(alive)
        self.exact += len(a)
        if not len(a):
            return
        if len(a) > 0.1 * nq * nx or np.abs(self.q).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1] >= 2**53:
            some = np.flatnonzero(alive.any(1))
            scores = np.zeros((nq, nx), np.int64)
            scores[some] = _exact(self.q[some], x)
            self.offer(a, scores[a, b], ids[b])
        else:
            for i in range(0, len(a), 1 << 17):
                p, r = a[i : i + (1 << 17)], b[i : i + (1 << 17)]
                self.offer(p, np.einsum("ij,ij->i", self.q[p].astype(np.float64), rows[r]).astype(np.int64), ids[r])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros, and so is the part beyond ``width``, which no query has."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.asarray(column.offsets)[: len(column) + 1].astype(np.int64)
    size = np.diff(ends)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    take = np.minimum(size, width)
    out.reshape(-1)[C.ragged_index(np.arange(len(size)) * width, take)] = flat[C.ragged_index(ends[:-1] - ends[0], take)]
    return out


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v: each component x as floor(scale * x); rows without a vector, or with a null or non-finite component, are left out."""
    base = C.pick(rows, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return base.where(F.col("e").isNotNull() & whole).select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192) -> DataFrame:
    """The k rows with the largest inner product with each query: query_id, rank, vec_id, score.

    ``rows`` and ``queries`` hold vec_id and v (integers).  Rows with the query's
    vec_id count as its own and are not candidates.  Ties go to the smaller
    vec_id, null last.  Vectors of unequal length are compared as if filled with
    zeros.  A query that is given twice is answered twice.  An empty table gives
    an empty result.
    """
    spark = rows.sparkSession
    C.ship(spark)
    done: list[DataFrame] = []

    def search(ids: list[int], vectors: list[list[int]], turn: int, last: bool) -> None:
        width = max(map(len, vectors), default=0)
        q = np.zeros((len(vectors), width), np.int64)
        for i, v in enumerate(vectors):
            q[i, : len(v)] = v
        given = spark.sparkContext.broadcast((np.array([_NO_ID - 1 if i is None else i for i in ids], np.int64), q))  # ``block`` vectors at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, matrix = given.value
            best = Best(matrix, own, k)
            step = max(16, min(_ROWS, (32 << 20) // (24 * max(1, len(matrix)))))
            for batch in batches:
                vec_ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                x = _matrix(batch.column(1), matrix.shape[1])
                for i in range(0, len(vec_ids), step):
                    best.look(x[i : i + step], vec_ids[i : i + step])
            vec = pa.array(best.row, mask=best.row == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.query), turn, np.int32)), pa.array(best.query), pa.array(own[best.query]), vec, pa.array(best.score)], ["turn", "q", "query_id", "vec_id", "score"])

        found = C.in_arrow(rows.select("vec_id", "v"), run, "turn int, q long, query_id long, vec_id long, score long")
        place = C.row_number(["turn", "q"], F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        out = found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        done.append(out if last and not done else C.stored(out, "topk")[0])

    ids, vectors, turn = [], [], 0
    for r in queries.select("vec_id", "v").toLocalIterator(prefetchPartitions=False):
        if len(ids) == block:
            search(ids, vectors, turn, False)
            ids, vectors, turn = [], [], turn + 1
        ids.append(r["vec_id"])
        vectors.append(r["v"])
    search(ids, vectors, turn, True)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
