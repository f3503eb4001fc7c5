"""Predicates and boolean operators."""

from __future__ import annotations

from .. import types as T
from ..nodes import Expr, as_expr, combine, omit


def _none(x) -> bool:
    return x is None or (isinstance(x, Expr) and x.kind == "value" and x.key[1] == "NoneType")


def _two(a, b):
    """Both as expressions; a plain value takes its sibling's domain."""
    if not isinstance(a, Expr):
        raise T.DomainError("the left operand must be an expression")
    return a, as_expr(b, a.domain)


def comparison(op: str, a, b) -> Expr:
    """a op b; = and <> with a null value become IS [NOT] NULL, other operators refuse it."""
    if _none(b) and op in ("=", "<>"):
        return is_null(a) if op == "=" else is_not_null(a)
    if _none(b) and not op.startswith("IS"):
        raise TypeError(f"{op} with NULL is never true; use is_null() or is_not_null()")
    a, b = _two(a, b)
    if op in ("LIKE", "NOT LIKE", "ILIKE"):
        T.require(a.domain, "text-like", op)
        T.require(b.domain, "text-like", op)
    elif op in ("<", "<=", ">", ">="):
        T.require_order(a.domain, b.domain, op)
    else:
        T.require_equal(a.domain, b.domain, op)
    facts = {"nullable": False} if op.startswith("IS") else {}
    if op == "ILIKE":
        facts["capabilities"] = frozenset(["ilike"])
    return combine("operator", lambda ctx: f"({a.render(ctx)} {ctx.operator(op)} {b.render(ctx)})", (a, b), T.BOOLEAN, op, **facts)


def _made(op, name, doc):
    def f(a, b) -> Expr:
        return comparison(op, a, b)

    f.__name__, f.__doc__ = name, doc
    return f


eq = equal = _made("=", "eq", "a = b; IS NULL for a null value")
ne = not_equal = _made("<>", "ne", "a <> b; IS NOT NULL for a null value")
lt = less_than = _made("<", "lt", "a < b")
lte = less_than_or_equal = _made("<=", "lte", "a <= b")
gt = greater_than = _made(">", "gt", "a > b")
gte = greater_than_or_equal = _made(">=", "gte", "a >= b")
like = _made("LIKE", "like", "a LIKE b")
not_like = _made("NOT LIKE", "not_like", "a NOT LIKE b")
ilike = _made("ILIKE", "ilike", "case-insensitive LIKE")
is_distinct_from = _made("IS DISTINCT FROM", "is_distinct_from", "null-safe inequality")
is_not_distinct_from = _made("IS NOT DISTINCT FROM", "is_not_distinct_from", "null-safe equality")


def is_null(a: Expr) -> Expr:
    return combine("operator", lambda ctx: f"({a.render(ctx)} IS NULL)", (a,), T.BOOLEAN, "IS NULL", nullable=False)


def is_not_null(a: Expr) -> Expr:
    return combine("operator", lambda ctx: f"({a.render(ctx)} IS NOT NULL)", (a,), T.BOOLEAN, "IS NOT NULL", nullable=False)


def is_true(a: Expr) -> Expr:
    T.require(a.domain, "boolean", "IS TRUE")
    return combine("operator", lambda ctx: f"{a.render(ctx)} IS TRUE", (a,), T.BOOLEAN, "IS TRUE", nullable=False)


def between(a, low, high) -> Expr:
    if _none(low) or _none(high):
        raise TypeError("BETWEEN with NULL is never true")
    a, low = _two(a, low)
    high = as_expr(high, a.domain)
    T.require_order(a.domain, low.domain, "BETWEEN")
    T.require_order(a.domain, high.domain, "BETWEEN")
    return combine("operator", lambda ctx: f"({a.render(ctx)} BETWEEN {low.render(ctx)} AND {high.render(ctx)})", (a, low, high), T.BOOLEAN, "BETWEEN")


def _in(a, items, word, empty):
    items = [as_expr(x, a.domain) for x in items]
    for x in items:
        T.require_equal(a.domain, x.domain, word)
    if not items:
        return combine("operator", lambda ctx: empty, (a,), T.BOOLEAN, empty, nullable=False)
    return combine("operator", lambda ctx: f"({a.render(ctx)} {word} ({', '.join(x.render(ctx) for x in items)}))", (a, *items), T.BOOLEAN, word)


def in_list(a: Expr, items) -> Expr:
    """IN; false for an empty list."""
    return _in(a, list(items), "IN", "(1 = 0)")


def not_in(a: Expr, items) -> Expr:
    """NOT IN; true for an empty list, whatever the operand."""
    return _in(a, list(items), "NOT IN", "(1 = 1)")


def _logic(word, terms):
    if not terms:
        raise T.QueryError(f"{word} needs an operand")
    some = [t for t in terms if t is not omit]
    for t in some:
        T.require(t.domain, "boolean", word)
    if not some:
        return omit
    return combine("operator", lambda ctx: "(" + f" {word} ".join(t.render(ctx) for t in some) + ")", some, T.BOOLEAN, word)


def and_(*terms) -> Expr:
    return _logic("AND", terms)


def or_(*terms) -> Expr:
    return _logic("OR", terms)


def not_(a: Expr) -> Expr:
    if a is omit:
        raise T.QueryError("NOT needs an operand")
    T.require(a.domain, "boolean", "NOT")
    if a.kind == "subquery":  # NOT IN as a conjunct is a null-aware anti join
        return combine("operator", lambda ctx: f"(NOT {a.render(ctx)})", (a,), T.BOOLEAN, "NOT subquery")
    return combine("operator", lambda ctx: f"(NOT {a.render(ctx)})", (a,), T.BOOLEAN, "NOT")
