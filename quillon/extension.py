"""Building blocks for one's own expressions, clauses, sources, queries and mutations."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Mapping

from . import types as T
from .functions.scalar import call, unsafe_expression
from .naming import sql_names
from .nodes import RESERVED, Clause, Expr, Query, Source, as_expr, column

# --- expressions and text -------------------------------------------------------------------------------------------


def fragment(render: Callable, *args: Expr, domain: T.Domain = T.UNKNOWN) -> Expr:
    """Text of one's own: render(ctx) may quote names and bind parameters; ``args`` are the expressions it uses."""
    from .nodes import combine

    return combine("fragment", render, args, domain, (id(render),), nullable=True, schema_safe=False)


def is_fragment(x) -> bool:
    """Whether x can be rendered: an expression, clause, source or query."""
    return isinstance(x, Expr | Clause | Source | Query)


def expression_fragment(e: Expr) -> Expr:
    """The expression as a fragment; it is one already."""
    if not isinstance(e, Expr):
        raise T.QueryError("not an expression")
    return e


def keyword(word: str) -> Expr:
    """Upper-case words of SQL."""
    if not word or not all(part.isalpha() and part.isascii() for part in word.split(" ")):
        raise T.QueryError(f"not a keyword: {word!r}")
    return unsafe_expression(word.upper())


syntax = unsafe = unsafe_expression


def qualified_identifier(first: str, *more: str) -> Expr:
    """Names quoted by the dialect, with dots between."""
    from .functions.scalar import identifier

    return identifier(first, *more)


def as_value(x, domain: T.Domain | None = None) -> Expr:
    """x itself if it is an expression, else a bound parameter."""
    return as_expr(x, domain)


def is_value_expression(x) -> bool:
    return isinstance(x, Expr) and x.kind == "value"


def is_null_operand(x) -> bool:
    """None, or a bound NULL."""
    return x is None or is_value_expression(x) and x.key[1] == "NoneType"


def render_operands(ctx, operands: Iterable) -> str:
    return ", ".join(as_expr(x).render(ctx) for x in operands)


def schema_call(name: str, *args, domain: T.Domain = T.UNKNOWN) -> Expr:
    """A built-in routine that is known to be deterministic, and so may stand in schema metadata."""
    made = call(name, *args, domain=domain)
    safe = all(as_expr(a).schema_safe or as_expr(a).kind in ("value", "column") for a in args)
    return dataclasses.replace(made, schema_safe=safe)


def make_schema_expression(render: Callable, *args: Expr, domain: T.Domain = T.UNKNOWN) -> Expr:
    """A fragment that is vouched for as deterministic."""
    return mark_schema_expression(fragment(lambda ctx: render(ctx, *(a.render(ctx) for a in args)), *args, domain=domain))


def mark_schema_expression(e: Expr) -> Expr:
    if e.aggregate or e.window or e.subquery:
        raise T.QueryError("aggregates, windows and subqueries can't stand in schema metadata")
    return dataclasses.replace(e, schema_safe=True)


def is_schema_expression(x) -> bool:
    return isinstance(x, Expr) and (x.schema_safe or x.kind in ("value", "column")) and not (x.aggregate or x.window or x.subquery)


def expression_category(e: Expr) -> str:
    """aggregate, window, subquery or scalar."""
    return "window" if e.window else "aggregate" if e.aggregate else "subquery" if e.subquery else "scalar"


# --- clauses, sources, queries --------------------------------------------------------------------------------------


def create_clause(kind: str, order: int, render: Callable, *exprs: Expr, provides: Iterable[Source] = (), repeats: bool = False) -> Clause:
    """A clause of a kind of one's own: its text stands where ``order`` says (SELECT 20, FROM 30 ... FETCH 100)."""
    from .operators.select import BUILT_IN

    if not kind or kind in BUILT_IN:
        raise T.QueryError(f"a clause of one's own has a kind of its own, not {kind!r}")
    return Clause(kind, order, render, exprs, tuple(provides), repeats=repeats)


def create_source(kind: str, name: str, columns: Mapping, render: Callable, keys: Iterable[Iterable[str]] = (), outer: Iterable[Source] = ()) -> Source:
    """A relation of a kind of one's own: render(ctx) gives its text in FROM, which ends with its name.

    ``keys`` are sets of columns that determine a row; ``outer`` the sources of enclosing queries that it uses.
    """
    names = sql_names({f: c.sql_name for f, c in columns.items()})
    held = tuple(frozenset(k) for k in keys)
    if any(not k or not k <= set(names) for k in held):
        raise T.QueryError(f"a key of {name} has columns of {name}")
    return Source(kind, name, names, render, {f: c.domain for f, c in columns.items()}, {f: c.nullable for f, c in columns.items()}, held, frozenset(outer))


def create_query(kind: str, row: Mapping[str, tuple], render: Callable, outer: Iterable[Source] = (), cardinality: str = "many", capabilities: Iterable[str] = ()) -> Query:
    """A query of one's own; ``row`` maps its fields to (domain, nullable). It can be a subquery, a source or be run."""
    if kind in MUTATIONS:
        raise T.QueryError("create_mutation() makes mutations")
    if cardinality not in ("many", "zero-or-one", "exactly-one"):
        raise T.QueryError(f"no such cardinality: {cardinality}")
    return Query(kind, dict(row), render, frozenset(outer), cardinality, frozenset(capabilities))


MUTATIONS = frozenset(["insert", "update", "delete"])


def create_mutation(kind: str, table: Source, render: Callable, returning: Clause | None = None) -> Query:
    """A mutation of one's own as text; the engine doesn't run it."""
    if table.kind != "table":
        raise T.QueryError("a mutation takes a table")
    by = {"returning": returning} if returning is not None else {}
    row = {k: (e.domain, e.nullable) for k, e in returning.info.items()} if returning is not None else {}
    return Query(kind, row, render, info=("own", table, by))


def has_returning_clause(query: Query) -> bool:
    """Whether a mutation gives rows back."""
    return query.info is not None and isinstance(query.info[-1], dict) and "returning" in query.info[-1]


def source_identity(source: Source):
    """What tells a source from every other, those of equal names included."""
    return ("source", id(source))


class Columns(Mapping):
    """Columns by name, as items and, but for reserved names, as attributes."""

    def __init__(self, held: Mapping[str, Expr]):
        self._held = dict(held)

    def __getitem__(self, name):
        return self._held[name]

    def __iter__(self):
        return iter(self._held)

    def __len__(self):
        return len(self._held)

    def __getattr__(self, name):
        if name.startswith("_") or name in RESERVED or name not in self._held:
            raise AttributeError(name)
        return self._held[name]


def expose_columns(source: Source, names: Iterable[str] | None = None) -> Columns:
    """The source's columns, or some of them; a name that is reserved is an item only."""
    return Columns({n: column(source, n) for n in (source.fields if names is None else names)})
