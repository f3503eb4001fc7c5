"""Relations: tables, aliases, derived tables, laterals, CTEs and custom sources."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field

from .. import types as T
from ..naming import sql_names
from ..nodes import Expr, Query, Source, column


@dataclass(frozen=True)
class Column:
    """A column definition.

    generated_as takes an expression or generated_column(), identity True or identity_column(). has_default and
    generated say what the database does by itself; left out, they follow from the descriptors.
    """

    domain: T.Domain
    nullable: bool = False
    default: object = None
    has_default: bool | None = None
    generated: bool | None = None
    generated_as: object = None
    virtual: bool = False
    identity: object = False
    on_update: object = None
    sql_name: str | None = None
    cast_type: str | None = None
    native: tuple | None = None


def _helper(domain):
    def make(**options) -> Column:
        return Column(domain, **options)

    make.__name__ = domain.name
    return make


integer, numeric, text, boolean, date = map(_helper, (T.INTEGER, T.DECIMAL, T.TEXT, T.BOOLEAN, T.DATE))
timestamp, uuid, json, bigint, binary = map(_helper, (T.TIMESTAMP, T.UUID, T.JSON, T.BIGINT, T.BINARY))
date_time, blob = timestamp, binary


def custom_column(domain: T.Domain = T.UNKNOWN, **options) -> Column:
    return Column(domain, **options)


def native_column(dialect: str, declaration: str, domain: T.Domain = T.UNKNOWN, **options) -> Column:
    return Column(domain, native=(dialect, declaration), **options)


dialect_column = native_column


def portable_storage(domain: T.Domain) -> dict:
    """Storage that every database maps by itself."""
    return {"kind": "portable", "type": domain.name}


def native_storage(dialect: str, declaration: str) -> dict:
    """Storage as one database declares it."""
    if not dialect.strip() or not declaration.strip():
        raise T.QueryError("native storage needs a dialect and a declaration")
    return {"kind": "native", "dialect": dialect, "declaration": declaration}


def storage_of(definition: Column) -> dict:
    return native_storage(*definition.native) if definition.native else portable_storage(definition.domain)


def nullable(definition: Column) -> Column:
    return dataclasses.replace(definition, nullable=True)


@dataclass(frozen=True)
class Table:
    """What a base relation's source knows besides its columns."""

    name: str
    columns: dict[str, Column]
    constraints: dict = field(default_factory=dict)
    indexes: dict = field(default_factory=dict)


def table(name: str, columns: dict[str, Column], metadata: Callable | dict | None = None) -> Source:
    """A base relation. ``metadata(source)`` gives constraints and indexes by name."""
    from ..schema import candidate_keys, check_behavior

    names = sql_names({f: c.sql_name for f, c in columns.items()})
    columns = {f: check_behavior(f, c) for f, c in columns.items()}
    base = Source("table", name, names, lambda ctx: ctx.table(name), {f: c.domain for f, c in columns.items()}, {f: c.nullable for f, c in columns.items()}, definition=Table(name, columns))
    found = metadata(base) if callable(metadata) else metadata or {}
    own = Table(name, columns, {k: v for k, v in found.items() if v.kind != "index"}, {k: v for k, v in found.items() if v.kind == "index"})
    object.__setattr__(base, "definition", own)
    object.__setattr__(base, "keys", candidate_keys(own))
    return base


def alias(what, name: str) -> Source:
    """A table under another name, which keeps its keys, or a query as a derived table."""
    if isinstance(what, Source):
        if what.kind not in ("table", "alias"):
            raise T.QueryError(f"a {what.kind} can't be renamed")
        base = what
        return Source("alias", name, what.fields, lambda ctx: ctx.table(base.definition.name, name), what.domains, what.nullables, what.keys, definition=what.definition)
    return _derived("derived", what, name, lambda ctx: f"({what.render(ctx.relation())}) AS {ctx.quote(name)}")


as_ = alias


def _derived(kind, query: Query, name: str, render, **facts) -> Source:
    if not query.row:
        raise T.QueryError("a query without columns can't be a source")
    names = sql_names({f: None for f in query.row})
    facts.setdefault("outer", query.outer)
    return Source(kind, name, names, render, {f: d for f, (d, _) in query.row.items()}, {f: n for f, (_, n) in query.row.items()}, definition=query, capabilities=query.capabilities, **facts)


def lateral(query: Query, name: str) -> Source:
    """A derived table that may use the sources before it, which its query names with correlate()."""
    return _derived("lateral", query, name, lambda ctx: f"LATERAL ({query.render(ctx.inner())}) AS {ctx.quote(name)}")


def cte(name: str, query: Query) -> Source:
    """A named query; with_cte() binds it."""

    def render(ctx):
        if name not in ctx.ctes:
            raise T.ScopeError(f"the CTE {name!r} is used but no with_cte() binds it")
        return ctx.quote(name)

    return _derived("cte", query, name, render)


def custom_source(name: str, columns: dict[str, Column], render: Callable, lateral_outer=()) -> Source:
    """A relation with its own text (table function, VALUES ...): render(ctx) ends with its alias."""
    names = sql_names({f: c.sql_name for f, c in columns.items()})
    return Source("custom", name, names, render, {f: c.domain for f, c in columns.items()}, {f: c.nullable for f, c in columns.items()}, outer=frozenset(lateral_outer))


def all_(source: Source) -> dict[str, Expr]:
    """All columns of a source by name."""
    return {f: column(source, f) for f in source.fields}


def require_fields(source: Source, fields: dict[str, T.Domain]) -> Source:
    """The source, if it has these fields with fitting domains."""
    for f, d in fields.items():
        if f not in source.fields:
            raise T.ScopeError(f"{source.name} has no column {f}")
        if d != T.UNKNOWN and source.domains[f] not in (d, T.UNKNOWN):
            raise T.DomainError(f"{source.name}.{f} is {source.domains[f].name}, not {d.name}")
    return source



