"""What every source of facts offers to the planner."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

#: Physical layout of stored facts; a fact is visible from tx until rx.
FACTS = "id bigint, e bigint, a bigint, t tinyint, i bigint, d double, s string, b binary, f array<float>, tx bigint, rx bigint"


@dataclass(frozen=True)
class Scan:
    """Facts of one attribute, or of all: columns e, v, tx, added, and a for all.

    ``distinct``: no two rows agree in all of e, v (and a).
    """

    df: DataFrame
    kind: str
    distinct: bool


class Source(Protocol):
    """Facts at one basis."""

    spark: SparkSession

    def scan(self, attribute: str, history: bool, entity: int | None = None, target: int | None = None) -> Scan | None:
        """Facts of an attribute; None if there is no such attribute.

        With an entity, or a referenced entity, others may be left out early.
        """

    def scan_all(self, history: bool) -> Scan:
        """Facts of all attributes, with values as structs."""

    def entity(self, constant: Any) -> int | None:
        """The entity of a name, an id or a lookup; None if there is none."""

    def named(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """``df`` with the name of the entity in ``column`` as ``out``, null where it has none."""
