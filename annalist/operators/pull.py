"""Pull: entities as JSON documents, following references."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import values as V
from annalist.model import Source
from annalist.plans.ast import check_pull
from annalist.shipping import ship


def _number_udf():
    @F.pandas_udf("string")
    def shown(x: pd.Series) -> pd.Series:
        from annalist.functions.values import canonical_number

        return x.map(lambda v: None if v is None or v != v else canonical_number(float(v)))

    return shown


def quoted(text: Column) -> Column:
    """A text as JSON; null for null."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, 2, F.length(whole) - 2))


def json_value(kind: str, x: Column, name: Column | None = None) -> Column:
    """The wire form of a value as JSON text."""
    if kind == "ref":
        shown = x.cast("string") if name is None else F.coalesce(quoted(name), x.cast("string"))
        return F.concat(F.lit('{"ref":'), shown, F.lit("}"))
    if kind == "text":
        return quoted(x)
    if kind == "float":
        return _number_udf()(x)
    if kind in ("int", "bool"):
        return x.cast("string")
    if kind == "instant":
        return F.concat(F.lit('{"instant":"'), F.date_format(F.timestamp_micros(x), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"}'))
    if kind == "bytes":
        return F.concat(F.lit('{"bytes":"'), F.base64(x), F.lit('"}'))
    if kind == "json":
        return F.concat(F.lit('{"json":'), x, F.lit("}"))
    if kind == "vector":
        return F.concat(F.lit('{"vector":'), F.to_json(x), F.lit("}"))
    return _but_floats(x, name).when(x["t"] == V.FLOAT, _number_udf()(x["d"]))


def _but_floats(x: Column, name: Column | None) -> Column:
    own = F.when(x["t"] == V.REF, json_value("ref", x["i"], name)).when(x["t"] == V.BOOL, (x["i"] == 1).cast("string"))
    for kind, tags in (("int", (V.INT,)), ("text", (V.TEXT, V.TEXT_REF)), ("instant", (V.INSTANT,)), ("bytes", (V.BYTES, V.BYTES_REF)), ("json", (V.JSON,)), ("vector", (V.VECTOR,))):
        own = own.when(x["t"].isin(*tags), json_value(kind, x[V.FIELD[kind]]))
    return own


def sort_text(kind: str, x: Column, name: Column | None = None) -> Column:
    """The JSON that values without an order of their own sort by; of mixed values all but the floats."""
    return _but_floats(x, name) if kind == "any" else json_value(kind, x, name)


def documents(source: Source, entities: DataFrame, pattern: list[Any], history: bool = False, depth: int = 1) -> DataFrame:
    """e and doc (canonical JSON text) of distinct entities ``e``; those with nothing to show are ``{}``.

    Each item of the pattern is one join; values of an attribute come in a fixed
    order, as a list where the attribute has many or the reference is followed
    backwards.  With ``*``, references are followed ``depth`` - 1 times, so a cycle
    ends there.
    """
    check_pull(pattern)
    ship(source.spark)
    parts: list[DataFrame] = []
    nested = {k: sub for item in pattern if isinstance(item, dict) for k, sub in item.items()}
    for item in [*nested, *(i for i in pattern if isinstance(i, str))]:
        if item == "*":
            rows = source.named(source.scan_all(False).df.join(entities, "e", "left_semi"), "a", "key")
            rows = source.named(rows.withColumn("__to", F.when(F.col("v.t") == V.REF, F.col("v.i"))), "__to", "__name")
            shown = json_value("any", F.col("v"), F.when(F.col("v.t") == V.REF, F.col("__name")))
            if depth > 1:
                inner = documents(source, rows.where("__to IS NOT NULL").select(F.col("__to").alias("e")).distinct(), ["*"], history, depth - 1)
                inner = inner.where("doc <> '{}'").select(F.col("e").alias("__to"), "doc")
                rows, shown = rows.join(inner, "__to", "left"), F.coalesce("doc", shown)
            listed = F.col("key").isin(getattr(source, "many_names", list)())
            parts.append(rows.where("key IS NOT NULL").select("e", "key", shown.alias("j"), listed.alias("list")))
            continue
        space, _, last = item.partition("/")
        backward = last.startswith("_")
        scan = source.scan(f"{space}/{last[1:]}" if backward else item, history)
        if scan is None or (backward and scan.kind != "ref"):
            continue
        many = F.lit(backward or bool(getattr(source, "many", lambda _: False)(item)))
        rows = scan.df.select(F.col("v" if backward else "e").alias("e"), F.col("e" if backward else "v").alias("x")).join(entities, "e", "left_semi")
        kind = "ref" if backward else scan.kind
        if item in nested and kind == "ref":
            inner = documents(source, rows.select(F.col("x").alias("e")).distinct(), nested[item], history).select(F.col("e").alias("x"), F.col("doc").alias("j"))
            rows = rows.join(inner, "x")
        elif kind == "ref":
            rows = source.named(rows, "x", "__name").withColumn("j", json_value("ref", F.col("x"), F.col("__name")))
        else:
            rows = rows.withColumn("j", json_value(kind, F.col("x")))
        parts.append(rows.select("e", F.lit(item).alias("key"), "j", many.alias("list")))
    out = entities.select("e").distinct()
    if not parts:
        return out.withColumn("doc", F.lit("{}"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    fields = every.where("j IS NOT NULL").groupBy("e", "key").agg(F.array_sort(F.collect_set("j")).alias("js"), F.max("list").alias("list"))
    shown = F.when(F.col("list") | (F.size("js") > 1), F.concat(F.lit("["), F.array_join("js", ","), F.lit("]"))).otherwise(F.col("js")[0])
    whole = fields.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("key", F.concat(quoted(F.col("key")), F.lit(":"), shown).alias("j")))).alias("items"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("}"))
    return out.join(whole, "e", "left").select("e", F.coalesce(text, F.lit("{}")).alias("doc"))


def pulled(source: Source, df: DataFrame, column: str, pattern: list[Any]) -> DataFrame:
    """``df`` with the entity in ``column`` replaced by its document."""
    docs = documents(source, df.select(F.col(column).alias("e")).distinct(), pattern)
    return df.join(docs, df[column] == docs["e"]).withColumn(column, F.col("doc")).drop("e", "doc")


def entity(source: Source, e: int, depth: int = 1) -> DataFrame:
    """One entity with everything it has, references followed ``depth`` - 1 times."""
    return documents(source, source.spark.createDataFrame([(e,)], "e long"), ["*"], depth=depth)
