"""What the corpus operators share: row keys, the shared folder and packed exchanges.

A packed exchange moves NumPy columns between tasks as a few binary cells per
(task, destination) instead of a row per entry.  ``dest`` is an integer that
Spark hashes to a partition, so everything with one ``dest`` meets in one task;
the payload columns ``c0 .. c5`` hold the raw bytes of the columns.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.shipping import ship

N_COLS = 6
PACKED = "dest int, kind int, " + ", ".join(f"c{i} binary" for i in range(N_COLS))
PACKED_ARROW = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), *((f"c{i}", pa.binary()) for i in range(N_COLS))])
#: Kind of whole texts; the largest, since a task gets its rows in the order of their kinds.
TEXT = 1000
_PART_BYTES = 24 << 20


#: What empties the caches that operators keep in a worker between tasks.
caches: list[Callable[[], object]] = []


def forget() -> None:
    """Empty all caches of this process, before an operator fills its own."""
    for clear in caches:
        clear()


def _give_back() -> None:
    """Return freed memory to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keep: bool = False) -> DataFrame:
    """``mapInArrow`` whose tasks begin without the caches of other operators (unless ``keep``) and give their memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        try:
            yield from work(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one if that is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
        atexit.register(_remove_local, at)
    return at


def _remove_local(at: str) -> None:
    import shutil

    shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)


#: Tables in the shared folder that nobody has dropped yet, in the order in which they were made.
made: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder."""
    made.append(f"{shared_dir(spark)}/annalist-{tag}-{uuid.uuid4().hex}")
    return made[-1]


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder, which cuts its lineage; the table read back, and its path."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``stored`` that no lazy result reads any more."""
    for path in paths:
        if path in made:
            made.remove(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# ---------------------------------------------------------------- sizes and keys


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of what ``df`` reads, which for files is their size, by any path that Spark can read."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # more stands for an unknown size


def parts_for(df: DataFrame) -> int:
    """Partitions for a shuffle of ``df``: as configured, and so many that each stays small."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(plan_bytes(df) / _PART_BYTES))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns by their exact name: of names that differ by case alone, or are repeated, the first fit."""
    have = df.columns
    return df.toDF(*(f"_{i}" for i in range(len(have)))).select(*(F.col(f"_{have.index(n)}").alias(n) for n in names))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns (key, doc_id, text, *carry): text is never null and key is unique and ordered as doc_id.

    Where doc_id is unique and never null, key is doc_id and nothing is moved.
    Else key is the row's place in the order of (doc_id with nulls last, text),
    found with one sort and one number per partition; rows that are alike in
    both get neighbouring places.
    """
    ship(docs.sparkSession)
    docs = pick(docs, id_col, text_col, *carry)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *carry)
    seen = base.agg(F.count("*").alias("n"), F.count("doc_id").alias("k"), F.count_distinct("doc_id").alias("d")).first()
    if seen.n == seen.d:
        return base.select(F.col("doc_id").alias("key"), "doc_id", "text", *carry)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    ranged = base.repartitionByRange(parts_for(base), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    table, _ = stored(ranged.withColumn("row", F.monotonically_increasing_id() % (1 << 33)), "keys")
    sizes = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.count("*").alias("n")).collect()}
    at, before = 0, []
    for part in sorted(sizes):
        before.append((part, at))
        at += sizes[part]
    first = docs.sparkSession.createDataFrame(before, "part int, __annalist_before long")
    return table.join(F.broadcast(first), "part").select((F.col("__annalist_before") + F.col("row")).alias("key"), "doc_id", "text", *carry)


def with_ids(out: DataFrame, base: DataFrame) -> DataFrame:
    """The result ``out`` by key with the doc_id of each key of ``keyed`` in its place."""
    if "__annalist_before" not in base._jdf.queryExecution().analyzed().toString():
        return out.withColumnRenamed("key", "doc_id")
    rest = [c for c in out.columns if c != "key"]
    return out.join(base.select("key", "doc_id"), "key").select("doc_id", *rest)


def row_number(partition: list[str], *order) -> F.Column:  # type: ignore[name-defined]
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


# ---------------------------------------------------------------- packed exchanges


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _partition(x: np.ndarray, n: int) -> np.ndarray:
    """The partition of n that Spark's hash partitioning sends an integer to (Murmur3, seed 42)."""
    def turn(v: np.ndarray, r: int) -> np.ndarray:
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n


@lru_cache(8)
def _numbers(n: int) -> np.ndarray:
    """For each of n partitions the least number that Spark sends there, so that n destinations fill n partitions evenly."""
    found, at = np.full(n, -1, np.int32), 0
    while (found < 0).any():
        x = np.arange(at, at + 4 * n + 64)
        where, first = np.unique(_partition(x, n), return_index=True)
        new = found[where] < 0
        found[where[new]] = x[first[new]]
        at += len(x)
    return found


def dest_of(keys: np.ndarray, n: int) -> np.ndarray:
    """A destination for each key, one per partition of an exchange of n partitions."""
    return _numbers(n)[(mix64(keys.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)]


def _cells(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values).view(np.uint8).reshape(-1)
    if data.nbytes >= 1 << 31:
        raise ValueError("a packed batch must stay under 2 GB")
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def packed(dest: np.ndarray, columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
    """One row per destination; ``columns`` are of one length, in the order that ``dest`` gives them, stably."""
    order = np.argsort(dest, kind="stable")
    by = dest[order]
    cuts = np.flatnonzero(np.diff(by)) + 1
    ends = np.append(cuts, len(by)) if len(by) else np.zeros(0, np.int64)
    first = np.concatenate([[0], cuts]) if len(by) else np.zeros(0, np.int64)
    cells = [_cells(c[order], ends) for c in columns]
    return packed_rows(by[first], kind, cells)


def packed_rows(dest: np.ndarray, kind: int, cells: list[pa.Array]) -> pa.RecordBatch:
    n = len(dest)
    cells = cells + [pa.nulls(n, pa.binary())] * (N_COLS - len(cells))
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(np.full(n, kind, np.int32)), *cells], schema=PACKED_ARROW)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces [start, start + length) of ``values``, one after the other."""
    return values[ragged_index(starts, lengths)]


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    return data[lo:hi], offsets - lo if len(column) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``most`` bytes each, or a single document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_rows(docs: DataFrame, n: int) -> DataFrame:
    """Whole texts of (key, text) as compressed packed rows, dealt by key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, 32 << 20):
                dest = dest_of(keys[i:j], n)
                order = np.argsort(dest, kind="stable")
                starts, lengths = offsets[i:j][order], np.diff(offsets[i : j + 1])[order]
                by = dest[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(by)) + 1, [len(by)]])
                own, k, ln, body = by[cuts[:-1]], [], [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    k.append(keys[i:j][order[a:b]].tobytes())
                    ln.append(lengths[a:b].astype(np.int64).tobytes())
                    body.append(squeeze.compress(ragged(data, starts[a:b], lengths[a:b]).tobytes()))
                yield packed_rows(own, TEXT, [pa.array(x, pa.binary()) for x in (k, ln, body)])

    return in_arrow(docs.select("key", "text"), pack, PACKED)


def opened(row: tuple[bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Keys, offsets and bytes of a packed row of ``text_rows``."""
    keys, lengths = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64)
    return keys, np.concatenate([[0], np.cumsum(lengths)]), zstandard.ZstdDecompressor().decompress(row[2], max_output_size=int(lengths.sum()) or 1)


class Rows:
    """Packed rows of one kind, as slices of Arrow batches; iterated, tuples of their cells and ``dest``."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []

    def __iter__(self) -> Iterator[tuple]:
        for part in self.parts:
            yield from _tuples(part)

    def column(self, i: int, dtype) -> np.ndarray:
        """All bytes of a payload column, one row's after the other's."""
        found = []
        for part in self.parts:
            x = part.column(2 + i)
            at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
            found.append(np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]] if x.buffers()[2] is not None else np.zeros(0, np.uint8))
        return np.concatenate(found or [np.zeros(0, np.uint8)]).view(dtype)


    def by_dest(self) -> dict[int, Rows]:
        out: dict[int, Rows] = {}
        for part in self.parts:
            dest = part.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, dest[1:] != dest[:-1])) if len(dest) else []
            for a, b in zip(cuts, [*cuts[1:], len(dest)], strict=True):
                out.setdefault(int(dest[a]), Rows()).parts.append(part.slice(a, b - a))
        return out


def _tuples(part: pa.RecordBatch) -> Iterator[tuple]:
    dests = part.column(0).to_pylist()
    for i in range(part.num_rows):
        yield (*(part.column(2 + c)[i].as_py() for c in range(N_COLS)), dests[i])


def meet(rows: DataFrame, n: int, work: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring packed rows of one ``dest`` to one task; ``work`` gets the partition's rows by kind.

    Spark sorts a partition by kind and dest, with spilling, so texts come last:
    they are an iterator that is read as it is consumed, one row at a time, and
    only what is to be known about them is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict = {}

        def texts(first: pa.RecordBatch) -> Iterator[tuple]:
            yield from _tuples(first)
            for batch in batches:
                yield from _tuples(batch)

        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1])) if len(kinds) else []
            for a, b in zip(cuts, [*cuts[1:], len(kinds)], strict=True):
                if kinds[a] == TEXT:
                    by[TEXT] = texts(batch.slice(a, b - a))
                else:
                    by.setdefault(int(kinds[a]), Rows()).parts.append(batch.slice(a, b - a))
            if TEXT in by:
                break
        if by:
            yield from work(by)

    return in_arrow(rows.repartition(n, "dest").sortWithinPartitions("kind", "dest"), run, schema)


def column(rows: Rows | list, i: int, dtype) -> np.ndarray:
    return rows.column(i, dtype) if rows else np.zeros(0, dtype)
