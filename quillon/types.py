"""SQL domains of expressions: which may be compared, ordered, or used as text, numbers and booleans."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Domain:
    """A domain with its equality and order groups; None in a group means the operation isn't defined."""

    name: str
    equality: str | None = None
    order: str | None = None
    kinds: frozenset = frozenset()


def _domain(name, equality=None, order=None, *kinds):
    return Domain(name, equality, order, frozenset(kinds))


UNKNOWN = _domain("unknown")
TEXT = _domain("text", "text", "text", "text-like")
UUID = _domain("uuid", "uuid")
INTEGER = _domain("integer", "numeric", "numeric", "numeric-like")
DECIMAL = _domain("decimal", "numeric", "numeric", "numeric-like")
BIGINT = _domain("bigint", "numeric", "numeric", "numeric-like")
BOOLEAN = _domain("boolean", "boolean", None, "boolean")
DATE = _domain("date", "date", "date")
TIMESTAMP = _domain("timestamp", "timestamp", "timestamp")
JSON = _domain("json")
BINARY = _domain("binary", "binary")


class QueryError(ValueError):
    """A query that can't be built."""


class DomainError(QueryError, TypeError):
    """Operands whose domains don't fit the operation."""


class ScopeError(QueryError):
    """A column of a source that the query doesn't provide."""


class GroupingError(QueryError):
    """An expression that isn't determined by the grouping keys."""


class CapabilityError(QueryError):
    """A feature that the dialect doesn't have."""


class UnsupportedError(QueryError):
    """A query that can be built but not run by Spark."""


def require(domain: Domain, kind: str, what: str) -> None:
    if domain != UNKNOWN and kind not in domain.kinds:
        raise DomainError(f"{what} needs a {kind} operand, not {domain.name}")


def require_equal(a: Domain, b: Domain, what: str) -> None:
    if UNKNOWN not in (a, b) and (a.equality is None or a.equality != b.equality):
        raise DomainError(f"{what}: {a.name} and {b.name} can't be compared")


def require_order(a: Domain, b: Domain, what: str) -> None:
    if UNKNOWN not in (a, b) and (a.order is None or a.order != b.order):
        raise DomainError(f"{what}: {a.name} and {b.name} can't be ordered")


def orderable(a: Domain, what: str) -> None:
    if a != UNKNOWN and a.order is None:
        raise DomainError(f"{what}: {a.name} has no order")
