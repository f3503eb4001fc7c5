"""Arithmetic, text functions, CASE, CAST, calls of any routine, aggregates, windows, JSON and raw SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from .. import types as T
from ..nodes import ROUTINE, Expr, as_expr, combine, omit, value


def _arithmetic(op, a, b):
    if not isinstance(a, Expr):
        raise T.DomainError("the left operand must be an expression")
    b = as_expr(b, a.domain)
    T.require(a.domain, "numeric-like", op)
    T.require(b.domain, "numeric-like", op)
    domain = T.DECIMAL if op == "/" or T.DECIMAL in (a.domain, b.domain) else a.domain
    return combine("operator", lambda ctx: f"({a.render(ctx)} {op} {b.render(ctx)})", (a, b), domain, op)


def add(a, b) -> Expr:
    return _arithmetic("+", a, b)


def subtract(a, b) -> Expr:
    return _arithmetic("-", a, b)


def multiply(a, b) -> Expr:
    return _arithmetic("*", a, b)


def divide(a, b) -> Expr:
    """a / b; fractional in Spark, an error for a zero divisor."""
    return _arithmetic("/", a, b)


def modulo(a, b) -> Expr:
    return _arithmetic("%", a, b)


def _call(name, args, domain, **facts):
    return combine("function", lambda ctx: f"{name}({', '.join(a.render(ctx) for a in args)})", args, domain, name, **facts)


def lower(a: Expr) -> Expr:
    T.require(a.domain, "text-like", "LOWER")
    return _call("LOWER", [a], T.TEXT)


def upper(a: Expr) -> Expr:
    T.require(a.domain, "text-like", "UPPER")
    return _call("UPPER", [a], T.TEXT)


def concat(*args) -> Expr:
    """CONCAT; NULL if an argument is."""
    args = [as_expr(a, T.TEXT) for a in args]
    for a in args:
        T.require(a.domain, "text-like", "CONCAT")
    return _call("CONCAT", args, T.TEXT)


def coalesce(first: Expr, *rest) -> Expr:
    args = [first, *(as_expr(a, first.domain) for a in rest)]
    for a in args[1:]:
        T.require_equal(first.domain, a.domain, "COALESCE") if first.domain.equality else None
    return _call("COALESCE", args, first.domain, nullable=False)


def case_when(condition: Expr, then, otherwise) -> Expr:
    T.require(condition.domain, "boolean", "CASE")
    like = then.domain if isinstance(then, Expr) else otherwise.domain if isinstance(otherwise, Expr) else None
    a, b = as_expr(then, like), as_expr(otherwise, like)
    return combine("case", lambda ctx: f"CASE WHEN {condition.render(ctx)} THEN {a.render(ctx)} ELSE {b.render(ctx)} END", (condition, a, b), a.domain if a.domain != T.UNKNOWN else b.domain, "CASE", nullable=a.nullable or b.nullable)


def cast(a, target, domain: T.Domain | None = None) -> Expr:
    """CAST to a column definition (spelled by the dialect) or to a type name taken as it is."""
    a = as_expr(a)
    if isinstance(target, str):
        return combine("cast", lambda ctx: f"CAST({a.render(ctx)} AS {target})", (a,), domain or T.UNKNOWN, ("CAST", target))
    own = target.domain
    return combine("cast", lambda ctx: ctx.dialect.cast(a.render(ctx), target), (a,), own, ("CAST", own.name, target.cast_type))


def typed_cast(a, target: str, domain: T.Domain) -> Expr:
    return cast(a, target, domain)


def routine_name(name: str) -> str:
    if not ROUTINE.match(name):
        raise T.QueryError(f"not a routine name: {name!r}")
    return name


def call(name: str, *args, domain: T.Domain = T.UNKNOWN) -> Expr:
    """Any routine, every built-in function of Spark SQL included; arguments are bound."""
    return _call(routine_name(name), [as_expr(a) for a in args], domain, nullable=True, schema_safe=False)


typed_call = call


# --- aggregates -------------------------------------------------------------------------------------------------


def _aggregate(name, a, domain, nullable=True, distinct=False):
    args = () if a is None else (a,)
    if a is not None and a.aggregate:
        raise T.GroupingError(f"{name} of an aggregate")
    if a is not None and a.window:
        raise T.GroupingError(f"{name} of a window function")
    out = combine("aggregate", lambda ctx: f"{name}({'DISTINCT ' * distinct}{a.render(ctx) if a is not None else '*'})", args, domain, (name, distinct), aggregate=True, nullable=nullable, schema_safe=False)
    object.__setattr__(out, "columns", frozenset())  # what is aggregated needs no grouping
    return out


def count(a: Expr | None = None) -> Expr:
    """COUNT(*) or COUNT of the values that aren't NULL."""
    return _aggregate("COUNT", a, T.BIGINT, nullable=False)


def count_distinct(a: Expr) -> Expr:
    return _aggregate("COUNT", a, T.BIGINT, nullable=False, distinct=True)


def sum_(a: Expr) -> Expr:
    T.require(a.domain, "numeric-like", "SUM")
    return _aggregate("SUM", a, a.domain)


def average(a: Expr) -> Expr:
    T.require(a.domain, "numeric-like", "AVG")
    return _aggregate("AVG", a, T.DECIMAL)


def minimum(a: Expr) -> Expr:
    T.orderable(a.domain, "MIN")
    return _aggregate("MIN", a, a.domain)


def maximum(a: Expr) -> Expr:
    T.orderable(a.domain, "MAX")
    return _aggregate("MAX", a, a.domain)


avg, min_, max_ = average, minimum, maximum


# --- windows ----------------------------------------------------------------------------------------------------


def _ranking(name):
    return Expr("ranking", lambda ctx: f"{name}()", (name,), T.BIGINT, nullable=False)


def row_number() -> Expr:
    return _ranking("ROW_NUMBER")


def rank() -> Expr:
    return _ranking("RANK")


def dense_rank() -> Expr:
    return _ranking("DENSE_RANK")


@dataclass(frozen=True, eq=False)
class WindowSpec:
    """A window that several functions share: over(f, spec)."""

    partition_by: tuple = ()
    order_by: tuple = ()


def window(partition_by: Iterable[Expr] = (), order_by: Iterable = ()) -> WindowSpec:
    return WindowSpec(tuple(partition_by), tuple(order_by))


def over(a: Expr, partition_by: Iterable[Expr] | WindowSpec = (), order_by: Iterable = ()) -> Expr:
    """a OVER (PARTITION BY ... ORDER BY ...).

    Spark has no ranking without an order and no distinct aggregate over a window; there the order is a
    constant, and the distinct count is the size of the collected set.
    """
    from ..operators.clauses import term

    if isinstance(partition_by, WindowSpec):
        partition_by, order_by = partition_by.partition_by, (*partition_by.order_by, *order_by)
    parts, orders = list(partition_by), [term(o) for o in order_by if o is not omit]
    if a.window:
        raise T.QueryError("a window function of a window function")

    def render(ctx):
        spark = ctx.dialect.name == "spark"
        if spark and a.kind not in ("aggregate", "ranking", "function", "unsafe", "custom"):
            raise T.UnsupportedError("only aggregates, rankings and calls can stand before OVER in Spark")
        distinct = spark and a.kind == "aggregate" and a.key[1][1]
        head = f"COLLECT_SET({a.inner[0].render(ctx)})" if distinct else a.render(ctx)
        spec = []
        if parts:
            spec.append("PARTITION BY " + ", ".join(p.render(ctx) for p in parts))
        if orders:
            spec.append("ORDER BY " + ", ".join(o.render(ctx) for o in orders))
        elif spark and a.kind == "ranking":
            spec.append("ORDER BY 1")
        whole = f"{head} OVER ({' '.join(spec)})"
        return f"CAST(SIZE({whole}) AS BIGINT)" if distinct else whole

    args = (a, *parts, *(o.expr for o in orders))
    aggregated = any(x.aggregate for x in (*a.inner, *parts, *(o.expr for o in orders)))
    out = combine("window", render, args, a.domain, ("OVER", len(parts), tuple((o.direction, o.nulls) for o in orders)), window=True, aggregate=aggregated, nullable=a.nullable, schema_safe=False)
    if a.kind == "aggregate":  # a windowed aggregate reads rows, so its argument's columns count
        object.__setattr__(out, "columns", out.columns | frozenset().union(*(x.columns for x in a.inner)) if a.inner else out.columns)
    return out


# --- JSON -------------------------------------------------------------------------------------------------------


def json_path(*steps) -> tuple:
    """Keys and non-negative indexes."""
    for s in steps:
        if isinstance(s, bool) or not isinstance(s, str | int) or (isinstance(s, int) and s < 0):
            raise T.QueryError(f"not a JSON path step: {s!r}")
    return steps


def _json(kind, doc, path, domain, nullable=True):
    path = json_path(*path) if isinstance(path, list | tuple) else json_path(path)
    if doc.domain not in (T.JSON, T.UNKNOWN, T.TEXT):
        raise T.DomainError(f"not a JSON document: {doc.domain.name}")
    return combine("json", lambda ctx: ctx.dialect.json(ctx, kind, doc, path), (doc,), domain, (kind, path), nullable=nullable, capabilities=frozenset(["json"]), schema_safe=False)


def json_text(doc: Expr, path) -> Expr:
    """The string at the path; NULL for anything else."""
    return _json("text", doc, path, T.TEXT)


def json_number(doc: Expr, path) -> Expr:
    return _json("number", doc, path, T.DECIMAL)


def json_boolean(doc: Expr, path) -> Expr:
    return _json("boolean", doc, path, T.BOOLEAN)


def json_exists(doc: Expr, path) -> Expr:
    """Whether the path is there, a JSON null included; never NULL."""
    return _json("exists", doc, path, T.BOOLEAN, nullable=False)


# --- extension --------------------------------------------------------------------------------------------------


def unsafe_expression(sql: str, domain: T.Domain = T.UNKNOWN) -> Expr:
    """Trusted SQL text."""
    return Expr("unsafe", lambda ctx: sql, ("unsafe", sql), domain)


def make_expression(render: Callable, *args: Expr, domain: T.Domain = T.UNKNOWN, aggregate: bool = False) -> Expr:
    """A custom expression: render(ctx, *texts of args)."""
    out = combine("aggregate" if aggregate else "custom", lambda ctx: render(ctx, *(a.render(ctx) for a in args)), args, domain, (id(render), False), aggregate=aggregate or any(a.aggregate for a in args), nullable=True, schema_safe=False)
    if aggregate:
        object.__setattr__(out, "columns", frozenset())
    return out


def schema_expression(a: Expr) -> Expr:
    """The same expression, vouched for as deterministic."""
    import dataclasses

    return dataclasses.replace(a, schema_safe=True)


def with_dialect_capability(a: Expr, capability: str) -> Expr:
    import dataclasses

    return dataclasses.replace(a, capabilities=a.capabilities | {capability})


def sequence(parts: Iterable, separator: str = "") -> Expr:
    """Expressions and trusted text one after the other."""
    parts = [p if isinstance(p, Expr) else unsafe_expression(p) for p in parts]
    return combine("custom", lambda ctx: separator.join(p.render(ctx) for p in parts), parts, extra=("sequence", separator))


def parenthesize(a: Expr) -> Expr:
    return combine("custom", lambda ctx: f"({a.render(ctx)})", (a,), a.domain, "()")


def comma_separated(parts: Iterable) -> Expr:
    return sequence(parts, ", ")


def identifier(*names: str) -> Expr:
    return Expr("custom", lambda ctx: ".".join(map(ctx.quote, names)), ("identifier", names))


parameter = value
