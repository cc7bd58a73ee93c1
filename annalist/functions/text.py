"""Text kernels: tokens, BM25, snippets and bounded strings."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.shipping import ship

#: Fixed values of the public BM25 of SQLite's FTS5.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET_TOKENS, TEXT_BYTES = 12, 2048
_WORD = r"[\p{L}\p{N}_]+"
_PART = r"[\p{L}\p{N}\p{Co}]+"
_BETWEEN = r"[^\p{L}\p{N}\p{Co}]+"
#: Bytes of text whose tokens are counted at once.
_PIECE = 4 << 20
#: Bytes of a posting in a run: fact, tf, and dl with the head's bit.
_ENTRY = 16


def _folded(text: Column) -> Column:
    """Lower case, without diacritics that decompose."""
    low = F.lower(text)
    plain = F.translate(low, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz")
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(plain, r"\p{Mn}", ""))  # ASCII has none


def tokens(text: Column) -> Column:
    """Tokens of a text: letters and digits, folded."""
    return F.regexp_extract_all(_folded(text), F.lit(_PART), F.lit(0))


def query_terms(text: Column) -> Column:
    """Words of a query, each a phrase of one or more tokens; all of them must match."""
    return F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), tokens)


def _pieces(batch: pa.RecordBatch, column: str = "words") -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some megabytes of a column at a time."""
    turn = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64) // _PIECE
    edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _counts(piece: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a piece (null: none) and, ordered by term and text, the number of each posting's term and text, its tf, dl and head."""
    rows, words = piece.num_rows, piece.column("words")
    split = pc.split_pattern(words, " ")  # of a text without tokens: one empty word
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(split.flatten())
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    key, tf = np.unique(place[coded.indices.to_numpy()] * rows + np.repeat(np.arange(rows), lengths), return_counts=True)
    term, text = np.divmod(key, rows)
    head = np.zeros(len(key), bool)
    head[np.unique(text, return_index=True)[1]] = True
    none = pc.equal(words, "").to_numpy(zero_copy_only=False)
    names = coded.dictionary.take(order)
    names = pc.if_else(pc.equal(names, ""), pa.scalar(None, names.type), names)
    return names, term, text, np.where(none[text], 0, tf), np.where(none, 0, lengths)[text].astype(np.int32), head


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (fact, words) the rows of ``counted``, ordered by term within a piece, so that they compress where they are moved."""
    for batch in batches:
        for piece in _pieces(batch):
            names, term, text, tf, dl, head = _counts(piece)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(term)), piece.column("fact").take(pa.array(text)), pa.array(tf), pa.array(dl), pa.array(head)],
                names=["term", "fact", "tf", "dl", "head"],
            )


def _places(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first byte of each entry of some runs lies, and how far its next byte is: a run has the first bytes of all its entries, then the second ones, and so on."""
    step = np.repeat(sizes, sizes)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(step)), step


def _pack(batches: Iterator[pa.RecordBatch], salts: int) -> Iterator[pa.RecordBatch]:
    """Of (fact, words) the rows of ``runs``."""
    for batch in batches:
        for piece in _pieces(batch):
            names, term, text, tf, dl, head = _counts(piece)
            facts = piece.column("fact").to_numpy(zero_copy_only=False)
            entries = np.empty(len(term), np.dtype([("fact", "<i8"), ("tf", "<u4"), ("dl", "<u4")]))
            entries["fact"], entries["tf"], entries["dl"] = facts[text], tf, dl.astype(np.uint32) * 2 + head
            sizes = np.bincount(term, minlength=len(names))  # each term has a text
            ends = np.concatenate([[0], np.cumsum(sizes)]) * _ENTRY
            at, step = _places(ends[:-1], sizes)
            flat, data = entries.view(np.uint8).reshape(-1, _ENTRY), np.empty(len(term) * _ENTRY, np.uint8)
            for i in range(_ENTRY):
                data[at + i * step] = flat[:, i]
            salt = zlib.crc32(facts[:1].tobytes()) % salts
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), salt, np.int32)), packed], names=["term", "salt", "packed"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (term, packed) the rows of ``counted``."""
    for batch in batches:
        for piece in _pieces(batch, "packed"):
            packed = piece.column("packed").cast(pa.large_binary())
            offsets = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, packed.offset * 8)
            data = np.frombuffer(packed.buffers()[2], np.uint8)
            sizes = np.diff(offsets) // _ENTRY
            at, step = _places(offsets[:-1], sizes)
            flat = np.empty((len(at), _ENTRY), np.uint8)
            for i in range(_ENTRY):
                flat[:, i] = data[at + i * step]
            entries = flat.reshape(-1).view(np.dtype([("fact", "<i8"), ("tf", "<u4"), ("dl", "<u4")]))
            dl = np.ascontiguousarray(entries["dl"])
            yield pa.RecordBatch.from_arrays(
                [piece.column("term").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.ascontiguousarray(entries["fact"])), pa.array(entries["tf"].astype(np.int64)), pa.array((dl >> 1).astype(np.int32)), pa.array((dl & 1).astype(bool))],
                names=["term", "fact", "tf", "dl", "head"],
            )


def _spaced(facts: DataFrame) -> DataFrame:
    """fact and words, the tokens with a space between them."""
    ship(facts.sparkSession)
    return facts.select("fact", F.trim(F.regexp_replace(_folded(F.coalesce("text", F.lit(""))), _BETWEEN, " ")).alias("words"))


def _rows(facts: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("term", T.StringType()), T.StructField("fact", facts.schema["fact"].dataType), T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType()), T.StructField("head", T.BooleanType())])


def apart(facts: DataFrame) -> bool:
    """Whether no fact is null or repeated."""
    seen = facts.agg(F.count("*").alias("n"), F.count_distinct("fact").alias("d")).first()
    return seen["n"] == seen["d"]


def counted(facts: DataFrame) -> DataFrame:
    """term, fact, tf, dl, head of (fact, text): how often a term is in a text of dl tokens.

    One row of each text is its head; that of a text without tokens, or of a null
    text, has no term.  A text is counted by itself, so no row is moved; only
    where facts are null or repeated, their rows are summed over a shuffle.
    """
    rows = _spaced(facts).mapInArrow(_count, _rows(facts))
    if apart(facts):
        return rows
    return rows.groupBy("term", "fact").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"), F.max("head").alias("head"))


def runs(facts: DataFrame, salts: int) -> DataFrame:
    """term, salt, packed of (fact, text), facts being longs that are ``apart``: a row for each term of some megabytes of text.

    ``packed`` has all postings of the term there, byte by byte of their columns,
    so that few rows are moved and they compress; ``salt`` (below ``salts``) is
    one number for all terms of these texts.
    """
    return _spaced(facts).mapInArrow(partial(_pack, salts=salts), "term string, salt int, packed binary")


def unpacked(packed: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of ``counted`` from those of ``runs``."""
    return packed.select("term", "packed").mapInArrow(_unpack, _rows(facts))


def postings(facts: DataFrame) -> DataFrame:
    """term, fact, tf, dl of (fact, text)."""
    return counted(facts).where("term IS NOT NULL").select("term", "fact", "tf", "dl")


def bm25(facts: DataFrame, query: str) -> DataFrame:
    """fact and rank (the smaller, the better) of the facts (fact, text) that hold every term of ``query``.

    One pass over the texts: document frequencies come from the rows that hold
    a term, the corpus's size and mean length from a global aggregate.
    """
    spark = facts.sparkSession
    phrases = [list(p) for p in spark.range(1).select(query_terms(F.lit(query)).alias("q")).first()["q"] if p]
    empty = facts.select("fact", F.lit(0.0).alias("rank")).where(F.lit(False))
    if not phrases:
        return empty
    split = facts.select("fact", tokens(F.col("text")).alias("ts"))

    def hits(p: list[str]) -> Column:
        if len(p) == 1:
            return F.size(F.filter("ts", lambda t: t == p[0]))
        at = F.sequence(F.lit(1), F.greatest(F.size("ts") - len(p) + 1, F.lit(1)))
        return F.size(F.filter(at, lambda i: F.slice("ts", i, len(p)) == F.array(*map(F.lit, p))))

    counted = split.select("fact", F.size("ts").alias("dl"), *(hits(p).alias(f"tf{i}") for i, p in enumerate(phrases)))
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(phrases))))
    rank = F.lit(0.0)
    for i in range(len(phrases)):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    matched = counted
    for i in range(len(phrases)):
        matched = matched.where(F.col(f"tf{i}") > 0)
    return matched.crossJoin(F.broadcast(totals)).select("fact", rank.alias("rank"))  # totals is one row


def capped(text: str, most: int = TEXT_BYTES) -> tuple[str, bool]:
    """At most ``most`` UTF-8 bytes, ending in an ellipsis if cut."""
    data = text.encode()
    if len(data) <= most:
        return text, False
    return data[: most - 3].decode("utf-8", "ignore") + "…", True


def snippet(text: str, query: str) -> str:
    """Up to twelve words around the first hit, hits in brackets."""
    import re

    words = re.findall(r"\w+", query.lower())
    found = list(re.finditer(r"\w+", text))
    hit = next((i for i, m in enumerate(found) if m[0].lower() in words), 0)
    lo = max(0, min(hit - SNIPPET_TOKENS // 2, len(found) - SNIPPET_TOKENS))
    hi = min(len(found), lo + SNIPPET_TOKENS)
    if not found:
        return ""
    out, at = [], found[lo].start()
    for m in found[lo:hi]:
        out.append(text[at : m.start()] + (f"[{m[0]}]" if m[0].lower() in words else m[0]))
        at = m.end()
    return ("…" if lo else "") + "".join(out) + ("…" if hi < len(found) else "")
