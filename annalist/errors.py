"""Typed failures: what a caller can tell apart."""

from __future__ import annotations


class EngineError(Exception):
    """Any failure that the engine reports on purpose."""


class NotFound(EngineError):
    """An unknown entity, attribute, lookup or transaction in a direct read."""


class Conflict(EngineError):
    """Two writes, or a write and a guard, that cannot both hold."""


class SchemaError(EngineError):
    """A name, declaration or final state that breaks the schema."""


class ValueTypeError(EngineError, TypeError):
    """A value that is malformed or of the wrong type."""


class QueryError(EngineError):
    """A query that is malformed, unsafe or compares what cannot be compared."""


class FormatError(EngineError):
    """Stored data that cannot be what was written."""


class ReadOnly(EngineError):
    """A write through a view."""


class TooLarge(EngineError):
    """A value, document or result beyond its bound."""


class Unsupported(EngineError):
    """An operation that this kind of view does not have."""
