"""Typed values: tags, wire forms, canonical JSON, and comparisons as columns.

A value is one of nine kinds.  A variable of one kind is a plain column (ref,
int and instant: LONG; float: DOUBLE; text and json: STRING; bool: BOOLEAN;
bytes: BINARY; vector: ARRAY<FLOAT>).  Where several kinds can meet, kind
``any``, it is a struct of the tag and one field per physical type, which Spark
can group, join and compare as a whole.
"""

from __future__ import annotations

import base64
import datetime
import json
import math
import re
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.errors import TooLarge, ValueTypeError

#: Physical tags, and the kinds that share a logical type.
REF, BOOL, INT, FLOAT, TEXT, INSTANT, BYTES, VECTOR, TEXT_REF, BYTES_REF, JSON = range(11)
KIND_OF_TAG = ("ref", "bool", "int", "float", "text", "instant", "bytes", "vector", "text", "bytes", "json")
TAG_OF_KIND = {"ref": 0, "bool": 1, "int": 2, "float": 3, "text": 4, "instant": 5, "bytes": 6, "vector": 7, "json": 10}
INLINE_BYTES, MAX_BYTES, MAX_DEPTH = 256, 1 << 20, 64
FIELD = {"ref": "i", "bool": "i", "int": "i", "instant": "i", "float": "d", "text": "s", "json": "s", "bytes": "b", "vector": "f"}
SPARK_TYPE = {"ref": "bigint", "bool": "boolean", "int": "bigint", "instant": "bigint", "float": "double", "text": "string", "json": "string", "bytes": "binary", "vector": "array<float>"}
STRUCT = "struct<t:tinyint,i:bigint,d:double,s:string,b:binary,f:array<float>>"
NUMERIC = {"int", "float"}
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
_RFC3339 = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(?:([Zz])|([+-])(\d\d):(\d\d))")


# ---------------------------------------------------------------- canonical JSON


def canonical_number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueTypeError("a number must be finite")
    if x == 0:
        return "0"
    whole = x == int(x)
    if whole and -(2**63) <= x < 2**63:
        return str(int(x))
    exact = Decimal(repr(x)).normalize()
    if not whole and abs(x) >= 1e-6:
        return format(exact, "f")
    # Tiny numbers, and whole ones that no 64-bit integer stands for.
    sign, digits, exponent = exact.as_tuple()
    head, rest = str(digits[0]), "".join(map(str, digits[1:]))
    return f"{'-' if sign else ''}{head}{'.' + rest if rest else ''}e{exponent + len(digits) - 1:+d}"


def canonical_json(x: Any, depth: int = MAX_DEPTH + 16) -> str:
    """Keys by code point, no white space, shortest numbers."""
    if depth < 0:
        raise TooLarge("JSON is nested too deeply")
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float):
        return canonical_number(x)
    if isinstance(x, str):
        try:
            x.encode()
        except UnicodeEncodeError:
            raise ValueTypeError("text is not valid Unicode") from None
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(canonical_json(v, depth - 1) for v in x) + "]"
    if isinstance(x, dict):
        if any(not isinstance(k, str) for k in x):
            raise ValueTypeError("JSON keys are text")
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(x[k], depth - 1)}" for k in sorted(x)) + "}"
    raise ValueTypeError(f"no JSON form for {type(x).__name__}")


# ---------------------------------------------------------------- instants and wire values


def parse_instant(text: str) -> int:
    """Microseconds since 1970 of an RFC 3339 time with at most six fraction digits of weight."""
    m = _RFC3339.fullmatch(text) if isinstance(text, str) else None
    if not m or (m[7] and m[7][6:].strip("0")):
        raise ValueTypeError(f"not an instant: {text!r}")
    try:
        at = datetime.datetime(*(int(m[i]) for i in range(1, 7)), int((m[7] or "0")[:6].ljust(6, "0")), datetime.UTC)
    except ValueError:
        raise ValueTypeError(f"not an instant: {text!r}") from None
    micros = (at - _EPOCH) // datetime.timedelta(microseconds=1)
    if m[9]:
        if int(m[10]) > 23 or int(m[11]) > 59:
            raise ValueTypeError(f"not an instant: {text!r}")
        micros -= (1 if m[9] == "+" else -1) * (int(m[10]) * 60 + int(m[11])) * 60_000_000
    render_instant(micros)
    return micros


def render_instant(micros: int) -> str:
    try:
        at = _EPOCH + datetime.timedelta(microseconds=micros)
    except OverflowError:
        raise ValueTypeError("an instant lies in the years 1 to 9999") from None
    return f"{at.year:04d}-{at:%m-%dT%H:%M:%S}.{at.microsecond:06d}Z"


def encode(wire: Any, declared: str | None = None) -> tuple[str, Any]:
    """(kind, Python value) of a wire value that is not a reference."""
    if isinstance(wire, bool):
        return "bool", wire
    if isinstance(wire, int):
        if not -(2**63) <= wire < 2**63:
            raise ValueTypeError("an integer has 64 bits")
        return ("float", float(wire)) if declared == "float" else ("int", wire)
    if isinstance(wire, float):
        if not math.isfinite(wire):
            raise ValueTypeError("a float must be finite")
        return "float", wire + 0.0
    if isinstance(wire, str):
        try:
            size = len(wire.encode())
        except UnicodeEncodeError:
            raise ValueTypeError("text is not valid Unicode") from None
        if size > MAX_BYTES:
            raise TooLarge("a value has at most 1 MiB")
        return "text", wire
    if isinstance(wire, dict) and len(wire) == 1:
        ((key, x),) = wire.items()
        if key == "instant":
            return "instant", parse_instant(x)
        if key == "bytes":
            try:
                data = base64.b64decode(x, validate=True)
            except (ValueError, TypeError):
                raise ValueTypeError("bytes are strict base64") from None
            if len(data) > MAX_BYTES:
                raise TooLarge("a value has at most 1 MiB")
            return "bytes", data
        if key == "vector":
            if not isinstance(x, list) or not x or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in x):
                raise ValueTypeError("a vector is a list of numbers")
            with np.errstate(over="ignore"):
                v = np.array(x, np.float32)
            if not np.isfinite(v).all():
                raise ValueTypeError("a vector is finite")
            return "vector", [float(y) for y in v]
        if key == "json":
            text = canonical_json(x, MAX_DEPTH)
            if len(text.encode()) > MAX_BYTES:
                raise TooLarge("a value has at most 1 MiB")
            return "json", text
    raise ValueTypeError(f"not a value: {wire!r}")


def render(kind: str, x: Any, name: str | None = None) -> Any:
    """The wire form of a value; ``name`` is that of a referenced entity."""
    if kind == "ref":
        return {"ref": name if name is not None else x}
    if kind == "instant":
        return {"instant": render_instant(x)}
    if kind == "bytes":
        return {"bytes": base64.b64encode(bytes(x)).decode()}
    if kind == "vector":
        return {"vector": [float(v) for v in x]}
    if kind == "json":
        return {"json": json.loads(x)}
    return bool(x) if kind == "bool" else x


def tag_of(kind: str, x: Any) -> int:
    if kind == "text":
        return TEXT if len(x.encode()) <= INLINE_BYTES else TEXT_REF
    if kind == "bytes":
        return BYTES if len(x) <= INLINE_BYTES else BYTES_REF
    return TAG_OF_KIND[kind]


# ---------------------------------------------------------------- columns


def literal(kind: str, x: Any) -> Column:
    if kind == "vector":
        return F.array(*(F.lit(float(v)) for v in x)).cast("array<float>")
    return F.lit(bytearray(x) if kind == "bytes" else x).cast(SPARK_TYPE[kind])


def to_struct(kind: str, x: Column) -> Column:
    """The struct of a value of one kind."""
    if kind == "any":
        return x
    tag = F.lit(TAG_OF_KIND[kind])
    if kind == "text":
        tag = F.when(F.octet_length(x) > INLINE_BYTES, TEXT_REF).otherwise(TEXT)
    elif kind == "bytes":
        tag = F.when(F.octet_length(x) > INLINE_BYTES, BYTES_REF).otherwise(BYTES)
    own = {"i": "bigint", "d": "double", "s": "string", "b": "binary", "f": "array<float>"}
    fields = [(x.cast(t) if FIELD[kind] == f else F.lit(None).cast(t)).alias(f) for f, t in own.items()]
    return F.struct(tag.cast("tinyint").alias("t"), *fields)


def from_fields(kind: str, row: dict[str, Column]) -> Column:
    """A plain column of a kind from the physical columns t, i, d, s, b, f."""
    if kind == "any":
        return F.struct(*(row[f].alias(f) for f in ("t", "i", "d", "s", "b", "f")))
    x = row[FIELD[kind]]
    return x.cast("boolean") if kind == "bool" else x


def int_float_order(i: Column, d: Column) -> Column:
    """-1, 0 or 1 as the integer is less than, equal to or more than the float, exactly."""
    whole = F.floor(d).cast("bigint")
    return F.when(d >= 2.0**63, -1).when(d < -(2.0**63), 1).otherwise(F.when(i < whole, -1).when(i > whole, 1).when(d > whole.cast("double"), -1).otherwise(0))


def numeric_order(ka: str, a: Column, kb: str, b: Column) -> Column:
    if ka == kb:
        return F.when(a < b, -1).when(a > b, 1).otherwise(0)
    return int_float_order(a, b) if ka == "int" else -int_float_order(b, a)


def equal(ka: str, a: Column, kb: str, b: Column) -> Column:
    """Equality of tag and value, with numbers compared by value, exactly."""
    if ka == kb != "any":
        return a == b
    if {ka, kb} == NUMERIC:
        return numeric_order(ka, a, kb, b) == 0
    if "any" not in (ka, kb):
        return F.lit(False)
    x, y = to_struct(ka, a), to_struct(kb, b)
    mixed = F.when((x["t"] == INT) & (y["t"] == FLOAT), int_float_order(x["i"], y["d"]) == 0).when((x["t"] == FLOAT) & (y["t"] == INT), int_float_order(y["i"], x["d"]) == 0)
    return F.coalesce(mixed, x == y)


def order_of_any(x: Column, y: Column) -> Column:
    """-1, 0 or 1 for structs of one tag, or both numeric; an error at run time for others."""
    same = x["t"] == y["t"]
    by = F.when(same & x["t"].isin(REF, BOOL, INT, INSTANT), F.when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0))
    by = by.when(same & (x["t"] == FLOAT), F.when(x["d"] < y["d"], -1).when(x["d"] > y["d"], 1).otherwise(0))
    by = by.when(x["t"].isin(TEXT, TEXT_REF) & y["t"].isin(TEXT, TEXT_REF), F.when(x["s"] < y["s"], -1).when(x["s"] > y["s"], 1).otherwise(0))
    by = by.when((x["t"] == INT) & (y["t"] == FLOAT), int_float_order(x["i"], y["d"])).when((x["t"] == FLOAT) & (y["t"] == INT), -int_float_order(y["i"], x["d"]))
    return by.otherwise(F.raise_error(F.lit("QueryError: values of unlike types have no order")).cast("int"))


def number_key(x: Column) -> Column:
    """A struct that sorts and compares numbers of a struct value by size, exactly, whether integers or floats."""
    whole = F.floor(x["d"]).cast("bigint")
    far = (x["t"] == FLOAT) & ((x["d"] >= 2.0**63) | (x["d"] < -(2.0**63)))  # beyond all integers
    near = F.when(x["t"] == FLOAT, F.when(~far, whole)).otherwise(x["i"])
    return F.struct(F.when(far, x["d"]).otherwise(0.0).alias("far"), F.coalesce(near, F.lit(0)).alias("whole"), F.when((x["t"] == FLOAT) & ~far, x["d"] - whole.cast("double")).otherwise(0.0).alias("part"))


def sort_key(x: Column, shown: Column) -> Column:
    """A struct that sorts values of mixed kinds: truth values, numbers, text, then the rest by their JSON (``shown``)."""
    number, text = x["t"].isin(INT, FLOAT), x["t"].isin(TEXT, TEXT_REF)
    category = F.when(x["t"] == BOOL, 0).when(number, 1).when(text, 2).otherwise(3)
    return F.struct(category.alias("category"), F.when(number, number_key(x)).when(x["t"] == BOOL, number_key(x)).alias("number"), F.when(text, x["s"]).when(category == 3, shown).alias("text"))
