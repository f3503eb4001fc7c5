"""Expressions, sources and queries as immutable values with the facts that validation needs."""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from . import types as T


class _Omit:
    def __repr__(self):
        return "omit"

    def __bool__(self):
        return False


#: Stands for an absent clause, predicate, order term, field or assignment.
omit = _Omit()
NONE: frozenset = frozenset()


@dataclass(frozen=True, eq=False)
class Expr:
    """A scalar expression.

    render(ctx) gives its SQL text. columns are the column references outside aggregates, sources those that it
    needs, outer those that come from an enclosing query, key its structure (equal keys are equal expressions).
    """

    kind: str
    render: Callable
    key: Any
    domain: T.Domain = T.UNKNOWN
    columns: frozenset = NONE
    sources: frozenset = NONE
    aggregate: bool = False
    window: bool = False
    subquery: bool = False
    nullable: bool = True
    capabilities: frozenset = NONE
    schema_safe: bool = False
    inner: tuple = ()

    def __eq__(self, other):
        from .functions import comparison

        return comparison.eq(self, other)

    def __ne__(self, other):
        from .functions import comparison

        return comparison.ne(self, other)

    def __lt__(self, other):
        from .functions import comparison

        return comparison.lt(self, other)

    def __le__(self, other):
        from .functions import comparison

        return comparison.lte(self, other)

    def __gt__(self, other):
        from .functions import comparison

        return comparison.gt(self, other)

    def __ge__(self, other):
        from .functions import comparison

        return comparison.gte(self, other)

    def __add__(self, other):
        from .functions import scalar

        return scalar.add(self, other)

    def __sub__(self, other):
        from .functions import scalar

        return scalar.subtract(self, other)

    def __mul__(self, other):
        from .functions import scalar

        return scalar.multiply(self, other)

    def __truediv__(self, other):
        from .functions import scalar

        return scalar.divide(self, other)

    def __mod__(self, other):
        from .functions import scalar

        return scalar.modulo(self, other)

    def __and__(self, other):
        from .functions import comparison

        return comparison.and_(self, other)

    def __or__(self, other):
        from .functions import comparison

        return comparison.or_(self, other)

    def __invert__(self):
        from .functions import comparison

        return comparison.not_(self)

    def __bool__(self):
        raise TypeError("an expression has no truth value; combine conditions with and_, or_, not_")

    def __hash__(self):
        return hash(self.key)


def is_expression(x) -> bool:
    return isinstance(x, Expr)


def value(x, domain: T.Domain | None = None) -> Expr:
    """A bound parameter."""
    return Expr("value", lambda ctx: ctx.parameter(x), ("value", type(x).__name__, _hashable(x)), domain or domain_of(x), nullable=x is None)


typed_value = value


def _hashable(x):
    try:
        hash(x)
    except TypeError:
        return id(x)
    return x


def domain_of(x) -> T.Domain:
    """Domain of a Python value; parameters of type str are unknown, so that they fit their sibling."""
    if isinstance(x, bool):
        return T.BOOLEAN
    if isinstance(x, int):
        return T.INTEGER
    if isinstance(x, float | decimal.Decimal):
        return T.DECIMAL
    if isinstance(x, str):
        return T.TEXT
    if isinstance(x, datetime.datetime):
        return T.TIMESTAMP
    if isinstance(x, datetime.date):
        return T.DATE
    if isinstance(x, bytes | bytearray):
        return T.BINARY
    return T.UNKNOWN


def as_expr(x, like: T.Domain | None = None) -> Expr:
    """x itself, or a bound parameter that takes the domain of its sibling."""
    return x if isinstance(x, Expr) else value(x, like)


def _below(render):
    """Operands of anything but AND aren't conjuncts of WHERE or HAVING."""
    return lambda ctx: render(ctx.arm() if ctx.conjunct else ctx)


def combine(kind: str, render: Callable, args, domain=T.UNKNOWN, extra=(), **facts) -> Expr:
    """An expression over ``args`` whose facts are theirs together."""
    args = tuple(args)
    if kind != "subquery" and extra not in ("AND", "NOT subquery"):
        render = _below(render)
    facts.setdefault("nullable", any(a.nullable for a in args))
    facts.setdefault("schema_safe", bool(args) and all(a.schema_safe or a.kind in ("value", "column") for a in args))
    return Expr(
        kind, render, (kind, extra, tuple(a.key for a in args)), domain,
        frozenset().union(*(a.columns for a in args)), frozenset().union(*(a.sources for a in args)),
        facts.pop("aggregate", any(a.aggregate for a in args)), facts.pop("window", any(a.window for a in args)),
        facts.pop("subquery", any(a.subquery for a in args)), capabilities=frozenset().union(facts.pop("capabilities", NONE), *(a.capabilities for a in args)), inner=args, **facts,
    )


RESERVED = frozenset("columns name kind alias render fields constraints indexes table_id".split())


@dataclass(frozen=True, eq=False)
class Source:
    """A relation for FROM: table, alias, derived table, lateral, CTE or custom."""

    kind: str
    name: str
    fields: dict[str, str]
    render: Callable
    domains: dict[str, T.Domain] = field(default_factory=dict)
    nullables: dict[str, bool] = field(default_factory=dict)
    keys: tuple = ()
    outer: frozenset = NONE
    definition: Any = None
    capabilities: frozenset = NONE

    @property
    def columns(self) -> dict[str, Expr]:
        return {f: column(self, f) for f in self.fields}

    def __getattr__(self, item):
        if item.startswith("_") or item not in self.__dict__.get("fields", ()):
            raise AttributeError(f"{self.__dict__.get('name')} has no column {item}")
        return column(self, item)

    def __getitem__(self, item):
        return column(self, item)


def column(source: Source, name: str) -> Expr:
    if name not in source.fields:
        raise T.ScopeError(f"{source.name} has no column {name}")

    def render(ctx):
        own = ctx.quote(source.fields[name])
        return own if ctx.bare else ctx.reference(source, f"{ctx.quote(source.name)}.{own}")

    ref = ColumnRef(source, name)
    return Expr("column", render, ("column", id(source), name), source.domains.get(name, T.UNKNOWN), frozenset([ref]), frozenset([source]), nullable=source.nullables.get(name, True))


@dataclass(frozen=True, eq=False)
class ColumnRef:
    source: Source
    name: str

    def __eq__(self, other):
        return isinstance(other, ColumnRef) and self.source is other.source and self.name == other.name

    def __hash__(self):
        return hash((id(self.source), self.name))


def is_column_reference(x) -> bool:
    return isinstance(x, Expr) and x.kind == "column"


@dataclass(frozen=True, eq=False)
class Clause:
    """A clause with its place in SQL; build(ctx) gives its text. A query has one of a kind, unless the kind repeats."""

    kind: str
    order: int
    build: Callable
    exprs: tuple = ()
    provides: tuple = ()
    nullable: tuple = ()
    outer: tuple = ()
    info: Any = None
    repeats: bool = False


@dataclass(frozen=True, eq=False)
class Query:
    """select, set, insert, update or delete; row maps result names to (domain, nullable)."""

    kind: str
    row: dict[str, tuple]
    render: Callable
    outer: frozenset = NONE
    cardinality: str = "many"
    capabilities: frozenset = NONE
    info: Any = None


ROUTINE = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)*\Z")
