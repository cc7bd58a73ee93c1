"""Schema reads and checks as queries that return the offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.values import KIND_OF_TAG


def kind_name(tag):
    return F.element_at(F.array(*(F.lit(k) for k in KIND_OF_TAG)), tag.cast("int") + 1)


def observed(live: DataFrame) -> DataFrame:
    """Per attribute of (e, a, t): live_facts, entities and the sorted kinds seen."""
    return live.groupBy("a").agg(F.count("*").alias("live_facts"), F.count_distinct("e").alias("entities"), F.array_join(F.array_sort(F.collect_set(kind_name(F.col("t")))), ",").alias("types"))


def cardinality_violations(live: DataFrame) -> DataFrame:
    """Entities with more than one value of a single-valued attribute (e, v)."""
    return live.groupBy("e").agg(F.count_distinct("v").alias("n")).where("n > 1")


def unique_violations(live: DataFrame) -> DataFrame:
    """Values of a unique attribute (e, v) that more than one entity holds."""
    return live.groupBy("v").agg(F.count_distinct("e").alias("owners")).where("owners > 1")


def duplicate_facts(live: DataFrame) -> DataFrame:
    """Live facts (e, a, v) that are there more than once."""
    return live.groupBy("e", "a", "v").agg(F.count("*").alias("n")).where("n > 1")


def missing(members: DataFrame, required: dict[str, DataFrame]) -> DataFrame:
    """(e, attribute) of members that lack a required attribute; ``required``: facts (e) by attribute."""
    parts = [members.select("e").join(facts.select("e"), "e", "left_anti").select("e", F.lit(a).alias("attribute")) for a, facts in required.items()]
    return reduce(DataFrame.unionByName, parts)


def not_allowed(present: DataFrame, members: DataFrame, allowed: list[str]) -> DataFrame:
    """(e, attribute) of members of a closed shape with an attribute (e, attribute) outside ``allowed``."""
    return present.join(members.select("e"), "e", "left_semi").where(~F.col("attribute").isin(allowed)).select("e", "attribute").distinct()


def dangling(references: DataFrame, identities: DataFrame) -> DataFrame:
    """References (e, v) to what is no identity (id)."""
    return references.join(identities, F.col("v") == F.col("id"), "left_anti")


def backward(facts: DataFrame) -> DataFrame:
    """Facts that end before they begin."""
    return facts.where("rx <= tx")
