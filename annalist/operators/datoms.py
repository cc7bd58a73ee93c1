"""Pages of the fact indexes, and the cursors that continue them."""

from __future__ import annotations

import base64
import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.errors import QueryError
from annalist.functions import values as V
from annalist.operators.temporal import datoms as as_events
from annalist.operators.temporal import visible

INDEXES = {"eavt": ("e", "a", "v"), "avet": ("a", "v", "e"), "vaet": ("v", "a", "e")}
MOST = 1000


def value_order(row: dict[str, Column]) -> list[Column]:
    """Stored values in their storage order: numbers, then text, then bytes and digests of what is stored elsewhere."""
    t = row["t"]
    number = F.when(t == V.FLOAT, row["d"]).when(t.isin(V.REF, V.BOOL, V.INT, V.INSTANT), row["i"].cast("double"))
    text = F.when(t.isin(V.TEXT, V.JSON), row["s"])
    payload = F.when(t == V.TEXT_REF, row["s"].cast("binary")).when(t == V.BYTES_REF, row["b"]).when(t == V.VECTOR, F.to_json(F.array(row["f"])).cast("binary"))
    blob = F.when(t == V.BYTES, row["b"]).otherwise(F.unhex(F.sha2(F.concat(F.unhex(F.lpad(F.hex(t.cast("bigint")), 2, "0")), payload), 256)))
    group = F.when(number.isNotNull(), 0).when(text.isNotNull(), 1).otherwise(2)
    # Integers that a float cannot tell apart are told apart by themselves.
    return [group, number, F.when(group == 0, row["i"]), text, F.hex(F.when(group == 2, blob))]


def sort_columns(index: str, value: list[Column]) -> list[Column]:
    out: list[Column] = []
    for part in INDEXES[index]:
        out += value if part == "v" else [F.col(part)]
    return [*out, F.col("t"), F.col("tx"), F.col("added"), F.col("id")]


def _digest(index: str, components: list[Any], source: str) -> str:
    return hashlib.sha256(V.canonical_json([index, [repr(c) for c in components], source]).encode()).hexdigest()


def write_cursor(basis: int, index: str, components: list[Any], source: str, seek: list[Any]) -> str:
    body = {"v": 1, "basis": basis, "index": index, "source": source, "args": _digest(index, components, source), "seek": seek}
    return base64.urlsafe_b64encode(V.canonical_json(body).encode()).decode().rstrip("=")


def read_cursor(cursor: str, basis: int, index: str, components: list[Any], source: str) -> list[Any]:
    try:
        if len(cursor) > 4096:
            raise ValueError
        body = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), b"-_", validate=True))
        if body["v"] != 1 or body["basis"] != basis or body["index"] != index or body["source"] != source or body["args"] != _digest(index, components, source):
            raise ValueError
        return list(body["seek"])
    except (ValueError, KeyError, TypeError):
        raise QueryError("the cursor is not one of this request") from None


def index_rows(facts: DataFrame, index: str, components: list[Any], source: str = "current", basis: int | None = None) -> tuple[DataFrame, list[Column]]:
    """Rows of an index under a prefix, with the columns that order them.

    ``facts`` has the physical layout; components are entity and attribute ids,
    and a (kind, value) pair for a value.
    """
    if index not in INDEXES:
        raise QueryError(f"no index {index!r}")
    if source not in ("current", "history"):
        raise QueryError("source is current or history")
    if len(components) > 3:
        raise QueryError("an index has three components")
    if source == "current":
        rows = visible(facts, basis).withColumn("added", F.lit(True)).drop("rx")
    else:
        rows = as_events(facts, basis)
    if index == "vaet":
        rows = rows.where(F.col("t") == V.REF)
    for part, x in zip(INDEXES[index], components, strict=False):
        if part != "v":
            rows = rows.where(F.col(part) == x)
            continue
        kind, value = ("ref", x) if index == "vaet" and isinstance(x, int) else x
        rows = rows.where((F.col("t") == V.tag_of(kind, value)) & (F.col(V.FIELD[kind]) == V.literal(kind, value).cast("bigint" if kind == "bool" else V.SPARK_TYPE[kind])))
    return rows, sort_columns(index, value_order({c: F.col(c) for c in ("t", "i", "d", "s", "b", "f")}))


def page(facts: DataFrame, index: str, components: list[Any] = (), source: str = "current", limit: int = 100, cursor: str | None = None, basis: int = 0) -> tuple[list[Any], str | None]:
    """(rows, cursor of the next page or None) of an index, pinned to a basis."""
    components = list(components)
    if isinstance(limit, bool) or not 1 <= limit <= MOST:
        raise QueryError("a page has 1 to 1000 rows")
    rows, order = index_rows(facts, index, components, source, basis)
    keys = [f"k{i}" for i in range(len(order))]
    rows = rows.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    if cursor is not None:
        seek = read_cursor(cursor, basis, index, components, source)
        if len(seek) != len(keys):
            raise QueryError("the cursor is not one of this request")
        after = F.lit(False)
        for k, x in reversed(list(zip(keys, seek, strict=True))):
            # Null sorts first, as the order below has it.
            at = F.lit(x).cast(rows.schema[k].dataType)
            more = F.col(k).isNotNull() if x is None else F.col(k) > at
            after = F.coalesce(more, F.lit(False)) | (F.col(k).eqNullSafe(at) & after)
        rows = rows.where(after)
    found = rows.orderBy(*(F.col(k).asc_nulls_first() for k in keys)).limit(limit + 1).collect()
    more = len(found) > limit
    found = found[:limit]
    return found, write_cursor(basis, index, components, source, [found[-1][k] for k in keys]) if more else None
