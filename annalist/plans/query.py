"""Running a query: inputs, projection, aggregates, order and rendering."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.errors import EngineError, QueryError
from annalist.functions import values as V
from annalist.model import Source
from annalist.plans import ast
from annalist.plans.compiler import Bindings, Compiler, name, once

_MAX, _MIN = 2**63 - 1, -(2**63)


def run(source: Source, query: dict[str, Any], args: dict[str, Any] | None = None) -> DataFrame:
    """The rows of a query.  ?x becomes column x, count(?x) count_x; a reference is its name (or id, as text)."""
    q = ast.parse(query)
    c = Compiler(source, q)
    c.build_rules()
    b = once(c.body(q.where, _inputs(c, q, args or {})))
    grouped = any(f.kind in ast.AGGREGATES for f in q.find)
    df, kinds, order = (_aggregate(b, q) if grouped else _project(b, q))
    df, order = _sorted_by(source, df, kinds, order)
    for f in q.find:
        if kinds[f.column] == "ref" and f.kind != "pull":
            df = source.named(df, f.column, "__name").withColumn(f.column, F.coalesce("__name", F.col(f.column).cast("string"))).drop("__name")
    shown = [f.column for f in q.find]
    for f in q.find:
        if f.kind == "pull":
            from annalist.operators.pull import pulled

            df = pulled(source, df, f.column, f.pattern)
    extra = [c for c in df.columns if c.startswith("o_")]
    if not grouped and (not b.distinct or {f.variable for f in q.find} != set(b.kinds)):
        # Rows that look alike are one; the first in order stands for them.
        df = df.groupBy(*shown).agg(*(F.min(x).alias(x) for x in extra)) if extra else df.distinct()
    df = _collapsed(df, [f.column for f in q.find if kinds[f.column] == "any" and f.kind != "pull"], shown, extra)
    if order:
        df = df.orderBy(*(F.col(k).asc() if up else F.col(k).desc() for k, up in order))
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.select(*shown)


def _collapsed(df: DataFrame, mixed: list[str], shown: list[str], extra: list[str]) -> DataFrame:
    """Rows whose values look alike in JSON are one: an integral float prints as the integer does."""
    if not mixed:
        return df

    def key(c: str) -> Column:
        x = F.col(c)
        whole = (x["t"] == V.FLOAT) & (x["d"] == F.floor(x["d"]).cast("double")) & (F.abs(x["d"]) < 2.0**63)
        return F.when(whole, F.struct(F.lit(V.INT).cast("tinyint").alias("t"), F.floor(x["d"]).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), x["s"].alias("s"), x["b"].alias("b"), x["f"].alias("f"))).otherwise(x)

    keyed = df.select("*", *(key(c).alias(f"k_{c}") for c in mixed))
    rest = [c for c in shown if c not in mixed]
    return keyed.groupBy(*rest, *(f"k_{c}" for c in mixed)).agg(*(F.min(c).alias(c) for c in [*mixed, *extra])).select(*shown, *extra)


def _sorted_by(source: Source, df: DataFrame, kinds: dict[str, str], order: list[tuple[str, bool]]) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """``df`` with a column ``o_..`` for every key whose values do not sort as they are: what has no order of its own sorts by its JSON."""
    from annalist.operators.pull import sort_text

    keys: dict[str, str] = {}
    for column, _ in order:
        kind = kinds[column]
        if column in keys or kind in ("int", "float", "text", "bool", "instant"):
            continue
        x, out = F.col(column), f"o_key{len(keys)}"
        if kind in ("ref", "any"):
            df = source.named(df.withColumn("__to", x if kind == "ref" else F.when(x["t"] == V.REF, x["i"])), "__to", "__name")
            shown = sort_text(kind, x, F.col("__name"))
        else:
            shown = sort_text(kind, x)
        df = df.withColumn(out, V.sort_key(x, shown) if kind == "any" else shown).drop("__to", "__name")
        keys[column] = out
    return df.drop(*(c for c in keys if c.startswith("o_"))), [(keys.get(column, column), up) for column, up in order]


def _inputs(c: Compiler, q: ast.Query, args: dict[str, Any]) -> Bindings | None:
    args = {k if k.startswith("?") else f"?{k}": v for k, v in args.items()}
    if set(args) != set(q.inputs):
        raise QueryError(f"arguments are {sorted(args)}, inputs {sorted(q.inputs)}")
    if not q.inputs:
        return None
    df, kinds = c.spark.range(1), {}
    for v in q.inputs:
        try:
            kind, x = ("ref", c.entity(args[v]["ref"])) if isinstance(args[v], dict) and set(args[v]) == {"ref"} else V.encode(args[v])
        except EngineError as e:
            raise QueryError(str(e)) from e
        if x is None:
            df = df.where(F.lit(False))
        df, kinds[v] = df.withColumn(name(v), V.literal(kind, x if x is not None else 0)), kind
    return Bindings(df.select(*(name(v) for v in q.inputs)), kinds)


def _project(b: Bindings, q: ast.Query) -> tuple[DataFrame, dict[str, str], list[tuple[Any, bool]]]:
    columns, kinds = [], {}
    for f in q.find:
        columns.append(b.col(f.variable).alias(f.column))
        kinds[f.column] = "ref" if f.kind == "pull" else b.kinds[f.variable]
        if f.kind == "pull" and b.kinds[f.variable] != "ref":
            raise QueryError("pull needs an entity")
    labels = {f.label: f for f in q.find}
    order = []
    for key, up in q.order:
        if key in labels and labels[key].kind != "pull":
            order.append((labels[key].column, up))
        elif key in b.kinds:
            columns.append(b.col(key).alias(f"o_{key[1:]}"))
            kinds[f"o_{key[1:]}"] = b.kinds[key]
            order.append((f"o_{key[1:]}", up))
    return b.df.select(*columns), kinds, order


def _aggregate(b: Bindings, q: ast.Query) -> tuple[DataFrame, dict[str, str], list[tuple[Any, bool]]]:
    keys = [f for f in q.find if f.kind == "var"]
    kinds = {f.column: b.kinds[f.variable] for f in keys}
    aggregates = []
    for f in q.find:
        if f.kind != "var":
            column, kinds[f.column] = _one(f, b)
            aggregates.append(column.alias(f.column))
    df = b.df.groupBy(*(b.col(f.variable).alias(f.column) for f in keys)).agg(*aggregates)
    labels = {f.label: f.column for f in q.find}
    return df, kinds, [(labels[k], up) for k, up in q.order]


def _one(f: ast.Find, b: Bindings) -> tuple[Column, str]:
    kind, x = b.kinds[f.variable], b.col(f.variable)
    if f.kind == "count":
        return F.count(F.lit(1)), "int"
    if f.kind == "count-distinct":
        return F.count_distinct(x), "int"
    if kind not in ("int", "float", "any"):
        Compiler.reject(b, f"{f.kind} needs numbers")
        return F.max(F.lit(None).cast("bigint")), "int"
    if kind == "any":
        whole, real = x["t"] == V.INT, x["t"] == V.FLOAT
        x = F.when(whole | real, x).otherwise(F.raise_error(F.lit(f"QueryError: {f.kind} needs numbers")).cast(V.STRUCT))
        if f.kind in ("min", "max"):  # the value itself, of its own type; of an integer and a float alike the integer
            key = F.struct(V.number_key(x).alias("n"), (x["t"] if f.kind == "min" else -x["t"]).alias("t"))
            return (F.min_by if f.kind == "min" else F.max_by)(x, key), "any"
        total = _finite(F.sum(F.when(real, x["d"]).otherwise(x["i"].cast("double"))))
        if f.kind == "avg":
            return total / F.count(x), "float"
        exact, n, reals = F.sum(x["i"].cast("decimal(20,0)")), F.count(x), F.count_if(real)
        return F.when(n == 0, F.lit(None).cast(V.STRUCT)).when(reals > 0, V.to_struct("float", total)).otherwise(V.to_struct("int", _in_64_bits(exact))), "any"
    if f.kind in ("min", "max"):
        return (F.min if f.kind == "min" else F.max)(x), kind
    if kind == "int":
        total = F.sum(x.cast("decimal(20,0)"))
        if f.kind == "avg":
            return total.cast("double") / F.count(x), "float"
        return _in_64_bits(total), "int"
    return _finite(F.sum(x) if f.kind == "sum" else F.sum(x) / F.count(x)), "float"


def _in_64_bits(total: Column) -> Column:
    over = (total > F.lit(_MAX).cast("decimal(38,0)")) | (total < F.lit(_MIN).cast("decimal(38,0)"))
    return F.when(over, F.raise_error(F.lit("QueryError: the sum leaves 64 bits")).cast("bigint")).otherwise(total.cast("bigint"))


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("QueryError: the result is not finite")).cast("double")).otherwise(x)
