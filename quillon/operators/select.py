"""select() and its validation, set operations, and subqueries as expressions."""

from __future__ import annotations

from collections import Counter

from .. import types as T
from ..nodes import Clause, Expr, Query, Source, as_expr, combine, omit

#: The clauses that are placed by their kind; others are by their order alone.
BUILT_IN = frozenset(["with", "distinct", "from", "join", "where", "group-by", "having", "order-by", "offset", "fetch", "correlate"])


def select(projection: dict[str, Expr], *clauses: Clause) -> Query:
    """A query of named expressions; clauses come in any order and are checked here."""
    if not isinstance(projection, dict):
        raise T.QueryError("a projection is a dict of names and expressions")
    fields = {k: as_expr(v) for k, v in projection.items() if v is not omit}
    if not fields:
        raise T.QueryError("a projection needs a field")
    clauses = [c for c in clauses if c is not omit]
    kinds = [c.kind for c in clauses]
    for kind, n in Counter(c.kind for c in clauses if not c.repeats).items():
        if n > 1:
            raise T.QueryError(f"a query has one {kind} clause, not {n}")
    clauses.sort(key=lambda c: c.order)  # stable: joins keep their order
    by = {c.kind: c for c in clauses}
    outer = _scope(fields, clauses)
    extra = _grouping(fields, clauses, by)
    nullable = {s for c in clauses for s in c.nullable}
    row = {k: (e.domain, e.nullable or not nullable.isdisjoint(e.sources)) for k, e in fields.items()}
    exprs = [*fields.values(), *(e for c in clauses for e in c.exprs)]
    caps = frozenset().union(*(e.capabilities for e in exprs), *(s.capabilities for c in clauses for s in c.provides), *(s.definition.capabilities for c in clauses if c.kind == "with" for s in c.info))
    return Query("select", row, lambda ctx: _text(ctx, fields, clauses, by, extra, bool(outer)), outer, _cardinality(kinds, by), caps, (fields, clauses))


def _scope(fields, clauses) -> frozenset:
    """Outer requirements; every other source that is used must be in FROM or a join."""
    provided = [s for c in clauses for s in c.provides]
    names = [s.name for s in provided]
    for n in names:
        if names.count(n) > 1:
            raise T.ScopeError(f"more than one source is named {n!r}")
    told = {s for c in clauses for s in c.outer}
    used: set[Source] = set()
    for e in (*fields.values(), *(x for c in clauses for x in c.exprs)):
        used |= e.sources
    for s in provided:
        used |= s.outer
    missing = [s.name for s in used if s not in provided and s not in told]
    if missing:
        raise T.ScopeError(f"not in FROM or a join: {', '.join(sorted(missing))}; name sources of enclosing queries with correlate()")
    return frozenset(s for s in used if s not in provided)


def _inside(expr: Expr, keys: set, allowed: set, stop: Expr | None = None):
    """Column references that no grouping key and no aggregate covers."""
    if expr.key in keys or expr.kind == "aggregate":
        return
    if expr.kind == "column":
        yield from (c for c in expr.columns if c not in allowed)
        return
    if expr.kind == "window" and expr.inner and expr.inner[0].kind == "aggregate":
        for x in (*expr.inner[0].inner, *expr.inner[1:]):
            yield from _inside(x, keys, allowed)
        return
    if not expr.inner:
        yield from (c for c in expr.columns if c not in allowed)
    for x in expr.inner:
        yield from _inside(x, keys, allowed)


def _grouping(fields, clauses, by) -> list[Expr]:
    """Checks grouped queries; returns the columns that a grouped key determines, for engines that must be told."""
    checked = [*fields.values(), *(e for k in ("having", "order-by") if k in by for e in by[k].exprs)]
    if not ("group-by" in by or "having" in by or any(e.aggregate for e in checked)):
        return []
    groups = by["group-by"].exprs if "group-by" in by else ()
    keys = {e.key for e in groups}
    grouped = {c for e in groups if e.kind == "column" for c in e.columns}
    fixed = set(grouped)
    extra = []
    for source in {c.source for c in grouped}:
        names = {c.name for c in grouped if c.source is source}
        if any(names.issuperset(k) for k in source.keys):
            for f, e in source.columns.items():
                fixed |= e.columns
                if f not in names:
                    extra.append(e)
    outer = {s for c in clauses for s in c.outer}
    for e in checked:
        bad = [c for c in _inside(e, keys, fixed) if c.source not in outer]
        if bad:
            raise T.GroupingError(f"{bad[0].source.name}.{bad[0].name} is neither grouped nor aggregated")
    used = set()
    for e in checked:
        used |= e.columns
    return [e for e in extra if not e.columns.isdisjoint(used)]


def _cardinality(kinds, by) -> str:
    fetch = by.get("fetch")
    if fetch is not None and fetch.info in (0, 1):
        return "zero-or-one"
    if any(isinstance(by[k].info, tuple) for k in ("fetch", "offset") if k in by):
        return "many"
    return "exactly-one" if set(kinds) <= {"distinct", "order-by", "with"} else "many"


def _text(ctx, fields, clauses, by, extra, correlated) -> str:
    provided = [s for c in clauses for s in c.provides]
    host = by["from"].provides[0] if "from" in by else None
    ctx = ctx.query(extra, provided, None if any(c.info in ("RIGHT JOIN", "FULL JOIN") for c in clauses if c.kind == "join") else host, host is not None and len(by["from"].provides) == 1)
    return ctx.frames[-1].hosted(ctx, _parts(ctx, fields, clauses, by, correlated))


def _parts(ctx, fields, clauses, by, correlated) -> str:
    out = [c.build(ctx) for c in clauses if c.kind == "with"]
    out += [c.build(ctx) for c in clauses if c.kind not in BUILT_IN and c.order < 20]
    names = ctx.result_names(fields)
    number = lambda k: (by[k].info[0] if isinstance(by[k].info, tuple) else by[k].info) if k in by else None
    terms = by["order-by"].info if "order-by" in by and ctx.dialect.name == "spark" and all(c.kind in BUILT_IN for c in clauses) else ()
    shown = {e.key for e in fields.values()}
    # Spark pages a correlated query by the order that its rows come in, which a shuffle doesn't keep: number them by the terms.
    paged = correlated and not {"offset", "fetch"}.isdisjoint(by) and ("distinct" not in by or all(t.expr.key in shown for t in terms))
    if terms and (paged or ("having" in by and "distinct" not in by)):
        # Nor does it resolve aggregates in ORDER BY above HAVING: sort by hidden columns of the grouped query.
        inside = [f"{e.render(ctx)} AS {ctx.quote(n)}" for n, e in zip(names, fields.values())] + [f"{t.expr.render(ctx)} AS {ctx.quote(f'_s{i}')}" for i, t in enumerate(terms)]
        body = " ".join(c.build(ctx) for c in clauses if c.kind not in ("with", "distinct", "order-by", "offset", "fetch", "correlate"))
        last = ", ".join(ctx.quote(f"_s{i}") + (f" {t.direction}" if t.direction else "") + (f" NULLS {t.nulls}" if t.nulls else "") for i, t in enumerate(terms))
        own, rows = ", ".join(map(ctx.quote, names)), f"(SELECT {'DISTINCT ' if 'distinct' in by else ''}{', '.join(inside)} {body}) AS {ctx.quote('_q')}"
        if not paged:
            out.append(f"SELECT {own} FROM {rows} ORDER BY {last}")
            return " ".join([*out, *filter(None, [ctx.dialect.page(ctx, number("offset"), number("fetch"))])])
        skip, place = number("offset") or 0, ctx.quote("_place")
        wanted = [f"{place} > {skip}"] * (skip > 0) + [f"{place} <= {skip + number('fetch')}"] * ("fetch" in by)
        out.append(f"SELECT {own} FROM (SELECT {own}, ROW_NUMBER() OVER (ORDER BY {last}) AS {place} FROM {rows}) AS {ctx.quote('_q')} WHERE {' AND '.join(wanted) or 'TRUE'}")
        return " ".join(out)
    word = "SELECT DISTINCT " if "distinct" in by else "SELECT "
    out.append(word + ", ".join(f"{e.render(ctx)} AS {ctx.quote(n)}" for n, e in zip(names, fields.values())))
    out += [c.build(ctx) for c in clauses if c.kind not in ("with", "distinct", "offset", "fetch", "correlate") and (c.kind in BUILT_IN or 20 <= c.order <= 100)]
    page = ctx.dialect.page(ctx, number("offset"), number("fetch"))
    out += [page] if page else []
    out += [c.build(ctx) for c in clauses if c.kind not in BUILT_IN and c.order > 100]
    return " ".join(out)


# --- set operations ---------------------------------------------------------------------------------------------


def set_operation(op: str, left: Query, right: Query) -> Query:
    """left op right; both sides have the same fields, which are matched by name."""
    if op not in ("UNION", "UNION ALL", "INTERSECT", "EXCEPT"):
        raise T.QueryError(f"no such set operation: {op}")
    if set(left.row) != set(right.row):
        raise T.QueryError(f"{op}: the sides have the fields {sorted(left.row)} and {sorted(right.row)}")
    for f in left.row:
        a, b = left.row[f][0], right.row[f][0]
        if T.UNKNOWN not in (a, b) and a.equality != b.equality:
            raise T.DomainError(f"{op}: {f} is {a.name} on the left and {b.name} on the right")
    if list(left.row) != list(right.row) and right.kind == "select":
        fields, clauses = right.info
        right = select({f: fields[f] for f in left.row}, *clauses)
    row = {f: (d, n or right.row[f][1]) for f, (d, n) in left.row.items()}
    return Query("set", row, lambda ctx: f"({left.render(ctx.arm())}) {op} ({right.render(ctx.arm())})", left.outer | right.outer, capabilities=left.capabilities | right.capabilities)


def union(left: Query, right: Query) -> Query:
    return set_operation("UNION", left, right)


def union_all(left: Query, right: Query) -> Query:
    return set_operation("UNION ALL", left, right)


def intersect(left: Query, right: Query) -> Query:
    return set_operation("INTERSECT", left, right)


def except_(left: Query, right: Query) -> Query:
    return set_operation("EXCEPT", left, right)


# --- subqueries -------------------------------------------------------------------------------------------------


def _subquery(render, query: Query, args=(), domain=T.UNKNOWN, extra="", **facts) -> Expr:
    out = combine("subquery", render, args, domain, (extra, id(query)), subquery=True, capabilities=query.capabilities, schema_safe=False, **facts)
    object.__setattr__(out, "sources", out.sources | query.outer)
    return out


def scalar(query: Query) -> Expr:
    """The one value of a query with one column; NULL without a row."""
    if len(query.row) != 1:
        raise T.QueryError(f"a scalar subquery has one column, not {len(query.row)}")
    ((domain, nullable),) = query.row.values()
    return _subquery(lambda ctx: f"({query.render(ctx.inner())})", query, (), domain, "scalar", nullable=nullable or query.cardinality != "exactly-one")


def exists(query: Query) -> Expr:
    return _subquery(lambda ctx: f"EXISTS ({query.render(ctx.inner())})", query, (), T.BOOLEAN, "EXISTS", nullable=False)


def not_exists(query: Query) -> Expr:
    return _subquery(lambda ctx: f"NOT EXISTS ({query.render(ctx.inner())})", query, (), T.BOOLEAN, "NOT EXISTS", nullable=False)


def in_query(a: Expr, query: Query) -> Expr:
    """a IN (query of one column).

    Spark's IN is two-valued where it isn't a conjunct of WHERE or HAVING; there a CASE gives NULL when the
    operand or a row is NULL and nothing matches.
    """
    if len(query.row) != 1:
        raise T.QueryError(f"IN takes a query with one column, not {len(query.row)}")
    ((name, (domain, _)),) = query.row.items()
    T.require_equal(a.domain, domain, "IN")

    def render(ctx):
        plain = lambda: f"({a.render(ctx)} IN ({query.render(ctx.inner())}))"
        if ctx.dialect.name != "spark" or ctx.conjunct:
            return plain()
        column = ctx.quote(ctx.relation().result_names({name: None})[0])
        rows = lambda: f"({query.render(ctx.inner())}) AS {ctx.quote('_in')}"
        return (
            f"CASE WHEN NOT EXISTS (SELECT 1 FROM {rows()}) THEN FALSE WHEN {a.render(ctx)} IS NULL THEN NULL"
            f" WHEN EXISTS (SELECT 1 FROM {rows()} WHERE {ctx.quote('_in')}.{column} = {a.render(ctx.inner())}) THEN TRUE"
            f" WHEN EXISTS (SELECT 1 FROM {rows()} WHERE {ctx.quote('_in')}.{column} IS NULL) THEN NULL ELSE FALSE END"
        )

    return _subquery(render, query, (a,), T.BOOLEAN, "IN")


in_select = in_query
