"""Clauses of a select; they may be given in any order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .. import types as T
from ..nodes import Clause, Expr, Source, omit


def _condition(x, what):
    if x is not omit:
        T.require(x.domain, "boolean", what)
    return x


def distinct() -> Clause:
    return Clause("distinct", 20, lambda ctx: "DISTINCT")


def from_(*sources: Source) -> Clause:
    if not sources:
        raise T.QueryError("FROM needs a source")
    return Clause("from", 30, lambda ctx: "FROM " + ", ".join([ctx.marked(sources[0].render(ctx)), *(s.render(ctx) for s in sources[1:])]), provides=sources)


def _join(word, source, condition=None):
    on = () if condition is None else (_condition(condition, word),)

    def build(ctx):
        if ctx.dialect.name == "spark" and source.kind == "lateral" and word in ("RIGHT JOIN", "FULL JOIN", "NATURAL JOIN"):
            raise T.UnsupportedError(f"Spark has no {word} LATERAL")
        return f"{word} {source.render(ctx)}" + "".join(f" ON {c.render(ctx.per_row() if ctx.frames and ctx.frames[-1].alone else ctx)}" for c in on)

    return Clause("join", 40, build, on, (source,), (source,) if word == "LEFT JOIN" else (), info=word, repeats=True)


def inner_join(source: Source, condition: Expr) -> Clause:
    return _join("INNER JOIN", source, condition)


def left_join(source: Source, condition: Expr) -> Clause:
    return _join("LEFT JOIN", source, condition)


def right_join(source: Source, condition: Expr) -> Clause:
    return _join("RIGHT JOIN", source, condition)


def full_join(source: Source, condition: Expr) -> Clause:
    return _join("FULL JOIN", source, condition)


def cross_join(source: Source) -> Clause:
    return _join("CROSS JOIN", source)


def natural_join(source: Source) -> Clause:
    return _join("NATURAL JOIN", source)


def join(kind: str, source: Source, condition: Expr | None = None) -> Clause:
    word = kind.upper() + " JOIN"
    if word not in ("INNER JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN", "CROSS JOIN", "NATURAL JOIN"):
        raise T.QueryError(f"no such join: {kind}")
    return _join(word, source, condition)


def where(condition) -> Clause:
    if _condition(condition, "WHERE") is omit:
        return omit
    if condition.aggregate:
        raise T.GroupingError("an aggregate in WHERE; use having()")
    return Clause("where", 50, lambda ctx: "WHERE " + condition.render(ctx.top().per_row()), (condition,))


def group_by(*exprs: Expr) -> Clause:
    if not exprs:
        raise T.QueryError("GROUP BY needs an expression")
    if any(e.aggregate for e in exprs):
        raise T.GroupingError("an aggregate in GROUP BY")
    return Clause("group-by", 60, lambda ctx: "GROUP BY " + ", ".join([*(e.render(ctx) for e in exprs), *ctx.determined()]), exprs)


def having(condition) -> Clause:
    if _condition(condition, "HAVING") is omit:
        return omit
    return Clause("having", 70, lambda ctx: "HAVING " + condition.render(ctx.top()), (condition,))


@dataclass(frozen=True, eq=False)
class Order:
    expr: Expr
    direction: str | None = None
    nulls: str | None = None

    def render(self, ctx) -> str:
        return self.expr.render(ctx) + (f" {self.direction}" if self.direction else "") + (f" NULLS {self.nulls}" if self.nulls else "")


def order(expr: Expr, direction: str | None = None, nulls: str | None = None) -> Order:
    T.orderable(expr.domain, "ORDER BY")
    return Order(expr, direction and direction.upper(), nulls and nulls.upper())


def asc(expr: Expr, nulls: str | None = None) -> Order:
    return order(expr, "ASC", nulls)


def desc(expr: Expr, nulls: str | None = None) -> Order:
    return order(expr, "DESC", nulls)


def nulls_first(expr: Expr) -> Order:
    return order(expr, None, "FIRST")


def nulls_last(expr: Expr) -> Order:
    return order(expr, None, "LAST")


def term(x) -> Order:
    return x if isinstance(x, Order) else order(x)


def order_by(*terms) -> Clause:
    some = [term(t) for t in terms if t is not omit]
    if not some:
        return omit
    return Clause("order-by", 80, lambda ctx: "ORDER BY " + ", ".join(t.render(ctx) for t in some), tuple(t.expr for t in some), info=tuple(some))


def _number(n, what):
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"{what} needs a non-negative integer, not {n!r}")
    return n


def offset(n) -> Clause:
    return omit if n is omit else Clause("offset", 90, None, info=_number(n, "OFFSET"))


def fetch_first(n) -> Clause:
    return omit if n is omit else Clause("fetch", 100, None, info=_number(n, "FETCH"))


limit = fetch_next = fetch_first


def when(condition, clause) -> Clause:
    """The clause if the condition holds, else nothing; pagination under it proves no cardinality."""
    if clause.kind in ("from", "join", "group-by", "correlate", "with", "custom"):
        raise T.QueryError(f"{clause.kind} can't be conditional")
    if not condition:
        return omit
    return Clause(clause.kind, clause.order, clause.build, clause.exprs, clause.provides, clause.nullable, clause.outer, (clause.info, "conditional") if clause.kind in ("offset", "fetch") else clause.info)


def correlate(*sources: Source) -> Clause:
    """Names the sources of enclosing queries that this query uses."""
    if not sources:
        raise T.QueryError("correlate needs a source")
    return Clause("correlate", 25, None, outer=sources, repeats=True)


def with_cte(*ctes: Source) -> Clause:
    """Binds CTEs in order; later ones may use earlier ones."""
    if not ctes or any(c.kind != "cte" for c in ctes):
        raise T.QueryError("WITH needs CTEs")

    def build(ctx):
        parts = []
        for c in ctes:
            parts.append(f"{ctx.quote(c.name)} AS ({c.definition.render(ctx.relation())})")
            ctx.ctes.add(c.name)
        return "WITH " + ", ".join(parts)

    return Clause("with", 10, build, info=ctes, repeats=True)


with_queries = with_cte


def custom_clause(name: str, order: int, render: Callable, *exprs: Expr) -> Clause:
    """A clause at any position; render(ctx) gives its text and may bind parameters."""
    return Clause("custom", order, render, exprs, info=name, repeats=True)
