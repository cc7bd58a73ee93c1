"""Time travel over facts (e, ..., tx, rx): a fact is visible from tx until rx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.errors import NotFound, QueryError

FIRST_TX = 64


def visible(facts: DataFrame, basis: int | None = None) -> DataFrame:
    """Facts that hold now, or held after transaction ``basis``."""
    if basis is None:
        return facts.where("rx IS NULL")
    return facts.where((F.col("tx") <= basis) & (F.col("rx").isNull() | (F.col("rx") > basis)))


def datoms(facts: DataFrame, basis: int | None = None) -> DataFrame:
    """Facts as events: one row (added) at tx, and one (not added) at rx."""
    last = F.lit(2**62 if basis is None else basis)
    rest = [c for c in facts.columns if c not in ("tx", "rx")]
    opened = facts.where(F.col("tx") <= last).select(*rest, "tx", F.lit(True).alias("added"))
    closed = facts.where(F.col("rx") <= last).select(*rest, F.col("rx").alias("tx"), F.lit(False).alias("added"))
    return opened.unionByName(closed)


def hidden_rx(basis: int | None) -> Column:
    """rx as a view sees it: an end after the basis has not happened."""
    return F.col("rx") if basis is None else F.when(F.col("rx") <= basis, F.col("rx"))


def history(facts: DataFrame, entity: int | None = None, basis: int | None = None) -> DataFrame:
    """All facts of an entity, or of all, that were asserted up to the basis, with their ends."""
    out = facts if basis is None else facts.where(F.col("tx") <= basis)
    if entity is not None:
        out = out.where(F.col("e") == entity)
    return out.withColumn("rx", hidden_rx(basis))


def diff(facts: DataFrame, after: int, upto: int, basis: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(asserted, retracted) in (after, upto]; a later end than the view's basis is not seen."""
    if after > upto:
        raise QueryError("a diff runs forward in time")
    upto = upto if basis is None else min(upto, basis)
    asserted = facts.where((F.col("tx") > after) & (F.col("tx") <= upto)).withColumn("rx", hidden_rx(upto))
    retracted = facts.where((F.col("rx") > after) & (F.col("rx") <= upto))
    return asserted, retracted


def with_provenance(facts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Facts with at, by and source of their transaction, and of the one that ended them."""
    opened = transactions.select("tx", "at", "by", "source")
    closed = transactions.select(F.col("tx").alias("rx"), F.col("at").alias("rx_at"), F.col("by").alias("rx_by"), F.col("source").alias("rx_source"))
    return facts.join(opened, "tx", "left").join(closed, "rx", "left")


def basis_at(transactions: DataFrame, when: int) -> int:
    """The transaction that ``when`` names: itself if it is one, else the last one at or before that microsecond."""
    row = transactions.agg(F.max(F.when(F.col("tx") == when, F.col("tx"))).alias("same"), F.max(F.when(F.col("at") <= when, F.struct("at", "tx"))).alias("last")).first()
    if row["same"] is not None:
        return row["same"]
    if row["last"] is None:
        raise NotFound("nothing was written by then")
    return row["last"]["tx"]
