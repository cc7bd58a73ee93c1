"""Relational tables as facts, an attribute at a time.

A row is an entity, a column an attribute, a foreign key a reference.  Entity
ids are computed from keys, or from the file and row index where keys repeat,
so nothing is numbered by a shuffle, and a query reads only the columns of the
attributes that it names.  The ``events`` table
also gives attributes of users that change over time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions.values import to_struct
from annalist.model import Scan

#: Ids of one table, and of one conversation; a file of lineitem has room for so many rows.
SPAN = 1 << 59
TURNS = 1 << 20
ROWS = 1 << 36
#: What comes before the path of a file; Spark writes it in several ways.
_STORE = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


@dataclass(frozen=True)
class Attribute:
    table: str
    column: str
    kind: str
    target: str | None = None  # the table that a reference leads to


#: Entity tables in the order of their ids.
ORDER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "user", "documents", "embeddings", "conversations", "benchmark", "pages")
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "benchmark": "item_id", "pages": "page_id", "labels": "doc_id"}
_COLUMNS = {
    "region": "name:text", "nation": "name:text regionkey:ref:region", "customer": "name:text nationkey:ref:nation acctbal:float mktsegment:text",
    "supplier": "name:text nationkey:ref:nation acctbal:float", "part": "name:text brand:text type:text size:int retailprice:float",
    "orders": "custkey:ref:customer orderstatus:text totalprice:float orderdate:instant orderpriority:text",
    "lineitem": "orderkey:ref:orders partkey:ref:part suppkey:ref:supplier linenumber:int quantity:float extendedprice:float discount:float tax:float returnflag:text linestatus:text shipdate:instant",
    "events": "ts:instant user_id:ref:user event_type:text value:float props:text", "documents": "text:text lang:text source:text n_chars:int", "labels": "quality:int toxic:int",
    "embeddings": "embedding:vector label:int", "conversations": "role:text text:text", "benchmark": "text:text", "pages": "url:text html:text",
}
_PREFIX = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_"}


def _attributes() -> dict[str, Attribute]:
    out = {}
    for table, spec in _COLUMNS.items():
        for item in spec.split():
            column, kind, *target = item.split(":")
            shown = column.removesuffix("_id").removesuffix("key") if kind == "ref" else column.replace("_", "-")
            owner = "documents" if table == "labels" else table
            out[f"{owner}/{shown}"] = Attribute(table, _PREFIX.get(table, "") + column, kind, target[0] if target else None)
    out["conversations/next"] = Attribute("conversations", "next", "ref", "conversations")
    out["part/next"] = Attribute("part", "next", "ref", "part")
    out["user/last-type"] = Attribute("events", "event_type", "text")
    out["user/last-value"] = Attribute("events", "value", "float")
    return out


ATTRIBUTES = _attributes()


def entity_id(table: str, key: Column) -> Column:
    return F.lit(ORDER.index(table) * SPAN) + key.cast("bigint")


def folded(changes: DataFrame) -> DataFrame:
    """Intervals [tx, rx) of one value per entity from (e, v, tx): a repeated value opens no new one."""
    by = Window.partitionBy("e").orderBy("tx")
    kept = changes.withColumn("p", F.lag("v").over(by)).where("p IS NULL OR p <> v").drop("p")
    return kept.withColumn("rx", F.lead("tx").over(by))


class TableSource:
    """The driver's tables at a basis; static tables were asserted in transaction 1."""

    def __init__(self, spark: SparkSession, sf_dir: str, basis: int | None = None) -> None:
        self.spark, self.sf_dir, self.basis = spark, sf_dir, basis

    def at(self, tx: int) -> TableSource:
        return TableSource(self.spark, self.sf_dir, tx if self.basis is None else min(tx, self.basis))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with _place: the number of their file in the order of names, and their index in it."""
        files = sorted(re.sub(_STORE, "", f) for f in rows.inputFiles())
        rows = rows.select("*", F.regexp_replace("_metadata.file_path", _STORE, "").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        if len(files) == 1:
            return rows.withColumn("_place", F.col("_row"))
        numbers = self.spark.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number long")
        number = F.when(F.col("_number").isNull(), F.raise_error(F.concat(F.lit("no number for file "), F.col("_file"))).cast("bigint")).otherwise(F.col("_number"))
        return rows.join(F.broadcast(numbers), "_file", "left").withColumn("_place", number * ROWS + F.col("_row"))

    def _entity(self, table: str) -> Column:
        if table == "lineitem":  # its keys repeat, so a row is known by its place
            return entity_id("lineitem", F.col("_place"))
        if table == "conversations":
            conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
            fits = conv.between(0, SPAN // TURNS - 1) & turn.between(0, TURNS - 1)
            return F.when(~fits, F.raise_error(F.concat(F.lit("no id for conversation "), conv, F.lit(" turn "), turn)).cast("bigint")).otherwise(entity_id("conversations", conv * TURNS + turn))
        return entity_id("documents" if table == "labels" else table, F.col(_KEYS[table]))

    def _value(self, name: str, x: Attribute) -> Column:
        if name == "conversations/next":
            return self._entity("conversations") + 1
        if name == "part/next":
            key = F.col("p_partkey")
            return entity_id("part", key - key % 8 + (key + 1) % 8)
        if x.kind == "ref":
            return entity_id(x.target, F.col(x.column))
        if x.kind == "instant":
            return F.unix_micros(F.col(x.column).cast("timestamp"))
        return F.col(x.column).cast({"int": "bigint", "float": "double", "text": "string", "vector": "array<float>"}[x.kind])

    def intervals(self, name: str, entity: int | None = None, target: int | None = None) -> DataFrame:
        """e, v, tx, rx of an attribute, whatever the basis.

        A wanted entity, or referenced entity, is turned back into a key, so that
        the filter reaches the scan; the caller filters on e and v all the same.
        """
        x = ATTRIBUTES[name]
        rows = self._placed(self.table(x.table)) if x.table == "lineitem" else self.table(x.table)
        if entity is not None:
            owner = "user" if name.startswith("user/") else "documents" if x.table == "labels" else x.table
            column = "user_id" if owner == "user" else _KEYS.get(x.table)
            if column is not None:
                rows = rows.where(F.col(column) == entity - ORDER.index(owner) * SPAN)
        if target is not None and x.target is not None and x.column in rows.columns:
            rows = rows.where(F.col(x.column) == target - ORDER.index(x.target) * SPAN)
        if name.startswith("user/"):
            return folded(rows.select(entity_id("user", F.col("user_id")).alias("e"), self._value(name, x).alias("v"), F.unix_micros(F.col("ts").cast("timestamp")).alias("tx")).where("v IS NOT NULL"))
        facts = rows.select(self._entity(x.table).alias("e"), self._value(name, x).alias("v")).where("v IS NOT NULL")
        if name in ("conversations/next", "part/next"):
            facts = facts.join(self.table(x.table).select(self._entity(x.table).alias("v")), "v", "left_semi").select("e", "v")
        return facts.withColumn("tx", F.lit(1).cast("bigint")).withColumn("rx", F.lit(None).cast("bigint"))

    def scan(self, attribute: str, history: bool = False, entity: int | None = None, target: int | None = None) -> Scan | None:
        if attribute not in ATTRIBUTES:
            return None
        kind, rows = ATTRIBUTES[attribute].kind, self.intervals(attribute, entity, target)
        moving = attribute.startswith("user/")
        if not history:
            seen = rows if self.basis is None else rows.where((F.col("tx") <= self.basis) & (F.col("rx").isNull() | (F.col("rx") > self.basis)))
            return Scan(seen.where("rx IS NULL").select("e", "v", "tx", F.lit(True).alias("added")) if self.basis is None and moving else seen.select("e", "v", "tx", F.lit(True).alias("added")), kind, True)
        last = F.lit(self.basis if self.basis is not None else 2**62)
        opened = rows.where(F.col("tx") <= last).select("e", "v", "tx", F.lit(True).alias("added"))
        closed = rows.where(F.col("rx") <= last).select("e", "v", F.col("rx").alias("tx"), F.lit(False).alias("added"))
        return Scan(opened.unionByName(closed) if moving else opened, kind, not moving)

    def fused(self, names: list[str], entity: int | None = None) -> tuple[DataFrame, list[str]] | None:
        """e, v0, v1, .. and the kinds of attributes of one table, read in one scan; None if they do not lie side by side.

        A row has all of them or is left out, as in the join of their scans.
        """
        own = [ATTRIBUTES.get(n) for n in names]
        if any(x is None or n.startswith("user/") or n.endswith("/next") for n, x in zip(names, own, strict=True)) or len({x.table for x in own}) != 1:
            return None
        table = own[0].table
        rows = self._placed(self.table(table)) if table == "lineitem" else self.table(table)
        if entity is not None and table in _KEYS:
            rows = rows.where(F.col(_KEYS[table]) == entity - ORDER.index("documents" if table == "labels" else table) * SPAN)
        out = rows.select(self._entity(table).alias("e"), *(self._value(n, x).alias(f"v{i}") for i, (n, x) in enumerate(zip(names, own, strict=True))))
        for i in range(len(names)):
            out = out.where(F.col(f"v{i}").isNotNull())
        if self.basis is not None and self.basis < 1:
            out = out.where(F.lit(False))
        return out, [x.kind for x in own]

    def scan_all(self, history: bool = False) -> Scan:
        out = None
        for name, x in ATTRIBUTES.items():
            s = self.scan(name, history)
            part = s.df.select("e", F.lit(self.attribute_id(name)).cast("bigint").alias("a"), to_struct(x.kind, F.col("v")).alias("v"), "tx", "added")
            out = part if out is None else out.unionByName(part)
        return Scan(out, "any", not history)

    @staticmethod
    def attribute_id(name: str) -> int:
        return 100 + list(ATTRIBUTES).index(name)

    def entity(self, constant: Any) -> int | None:
        if isinstance(constant, bool):
            return None
        if isinstance(constant, int):
            return constant
        if isinstance(constant, str) and ":" in constant:
            table, _, key = constant.partition(":")
            conv, _, turn = key.partition("-")
            if table in ORDER and conv.isdigit() and (turn.isdigit() or not turn):
                if int(conv) >= (SPAN // TURNS if turn else SPAN) or int(turn or 0) >= TURNS:
                    return None
                return ORDER.index(table) * SPAN + (int(conv) * TURNS + int(turn) if turn else int(conv))
        if isinstance(constant, str) and constant in ATTRIBUTES:
            return self.attribute_id(constant)
        return None

    def named(self, df: DataFrame, column: str, out: str) -> DataFrame:
        key = F.col(column) % SPAN
        table = F.element_at(F.array(*(F.lit(t) for t in ORDER)), F.shiftright(F.col(column), SPAN.bit_length() - 1).cast("int") + 1)
        shown = F.when(table == "conversations", F.concat(F.shiftright(key, TURNS.bit_length() - 1), F.lit("-"), key % TURNS)).otherwise(key.cast("string"))
        attribute = F.element_at(F.array(*(F.lit(n) for n in ATTRIBUTES)), F.least(F.greatest(F.col(column) - 99, F.lit(1)), F.lit(len(ATTRIBUTES))).cast("int"))
        known = F.when(F.col(column).between(100, 99 + len(ATTRIBUTES)), attribute)  # no region has such a key
        return df.withColumn(out, F.coalesce(known, F.concat(table, F.lit(":"), shown)))
