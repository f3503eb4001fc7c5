"""Schema metadata: keys, foreign keys, checks, indexes, column behavior, registries and snapshots."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from .. import types as T
from ..naming import snake_case
from ..nodes import Expr, Source


class SchemaError(T.QueryError):
    """Invalid metadata; diagnostics are (code, path, message)."""

    def __init__(self, diagnostics):
        self.diagnostics = list(diagnostics)
        super().__init__("; ".join(f"{c} at {p}: {m}" for c, p, m in self.diagnostics))


class MetadataError(SchemaError):
    """A key, constraint or index that can't be."""


class RegistryError(SchemaError):
    """Tables that don't fit into one registry."""


class ExpressionError(SchemaError):
    """An expression that schema metadata can't hold."""


class BehaviorError(SchemaError):
    """Descriptors of a column that contradict each other."""


class SnapshotError(SchemaError):
    """A registry that has no snapshot, or a document that is none."""


class CanonicalError(SnapshotError):
    """A value without canonical JSON; path says where it stands."""

    @property
    def path(self) -> str:
        return self.diagnostics[0][1]


@dataclass(frozen=True, eq=False)
class Constraint:
    """kind: primary, unique, unique-nullable, foreign, check or index."""

    kind: str
    columns: tuple = ()
    options: tuple = ()
    target: object = None
    expr: Expr | None = None

    def option(self, name, default=None):
        return dict(self.options).get(name, default)


def _columns(kind, columns, must=True):
    if not columns:
        raise MetadataError([("empty-columns", kind, "needs a column")])
    names = []
    for c in columns:
        if c.kind != "column":
            raise MetadataError([("not-a-column", kind, "takes bare columns")])
        if must and c.nullable:
            raise MetadataError([("nullable-key", kind, "takes columns that aren't nullable")])
        names.append(c.key[2])
    if len(set(names)) < len(names):
        raise MetadataError([("duplicate-column", kind, "names a column twice")])
    return tuple(names)


def primary_key(*columns: Expr, **options) -> Constraint:
    return Constraint("primary", _columns("primary key", columns), tuple(options.items()))


def unique(*columns: Expr, **options) -> Constraint:
    """A strict key: its columns are never NULL."""
    return Constraint("unique", _columns("unique", columns), tuple(options.items()))


def unique_constraint(*columns: Expr, nulls_distinct: bool = True, **options) -> Constraint:
    """Uniqueness that says nothing about NULLs, and so proves no key."""
    return Constraint("unique-nullable", _columns("unique constraint", columns, False), (("nulls_distinct", nulls_distinct), *options.items()))


def references(source: Source, *columns: str) -> tuple:
    return source, columns


def foreign_key(columns, target, **options) -> Constraint:
    """target: references(...) or a function that gives it; it must be an exact key of its table."""
    return Constraint("foreign", _columns("foreign key", tuple(columns), False), tuple(options.items()), target)


def foreign_target(constraint: Constraint) -> tuple:
    source, columns = constraint.target() if callable(constraint.target) else constraint.target
    if len(columns) != len(constraint.columns):
        raise MetadataError([("foreign-key-arity", source.name, "as many columns as the target has")])
    if frozenset(columns) not in source.keys:
        raise MetadataError([("foreign-key-target", source.name, f"{columns} isn't a key")])
    return source, tuple(columns)


def check(condition: Expr, **options) -> Constraint:
    T.require(condition.domain, "boolean", "CHECK")
    _safe(condition, "check")
    return Constraint("check", (), tuple(options.items()), expr=condition)


def index(*terms, unique: bool = False, where: Expr | None = None, include=(), **options) -> Constraint:
    return Constraint("index", terms, (("unique", unique), ("where", where), ("include", tuple(include)), *options.items()))


def _safe(e: Expr, what: str) -> None:
    if e.aggregate or e.window or e.subquery:
        raise ExpressionError([("schema-expression", what, "aggregates, windows and subqueries aren't allowed")])
    if not (e.schema_safe or e.kind in ("column", "value")):
        raise ExpressionError([("schema-expression", what, "the expression isn't known to be deterministic")])


def candidate_keys(table) -> tuple:
    """Sets of columns that determine a row: primary and strict unique keys, and full unique indexes on columns."""
    out = []
    for c in (*table.constraints.values(), *table.indexes.values()):
        if c.kind in ("primary", "unique"):
            out.append(frozenset(c.columns))
        elif c.kind == "index" and c.option("unique") and c.option("where") is None:
            exprs = [getattr(t, "expr", t) for t in c.columns]
            if all(e.kind == "column" and not e.nullable for e in exprs):
                out.append(frozenset(e.key[2] for e in exprs))
    return tuple(out)


# --- column behavior --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Default:
    """literal, expression or external"""

    kind: str
    value: object = None


def default_literal(x) -> Default:
    return Default("literal", canonical_literal(x))


def default_expression(e: Expr) -> Default:
    if e.columns:
        raise ExpressionError([("schema-expression", "default", "a default can't use columns")])
    return Default("expression", e)


def external_default() -> Default:
    return Default("external")


def canonical_literal(x):
    """null, bool, string or finite number; -0 becomes 0."""
    if x is None or isinstance(x, bool | str | int):
        return x
    if isinstance(x, float) and math.isfinite(x):
        return 0.0 if x == 0 else x
    raise BehaviorError([("invalid-literal", "default", f"not a literal: {x!r}")])


@dataclass(frozen=True)
class Generated:
    """A column that the database computes; without an expression it alone knows how. mode: stored or virtual."""

    expr: Expr | None
    mode: str = "stored"


@dataclass(frozen=True)
class Identity:
    """A column that the database numbers. mode: always or by-default."""

    mode: str = "always"
    dialect: str | None = None


def generated_column(e: Expr, mode: str = "stored") -> Generated:
    if mode not in ("stored", "virtual"):
        raise BehaviorError([("invalid-generated-mode", "generated", f"stored or virtual, not {mode!r}")])
    _safe(e, "generated")
    return Generated(e, mode)


def external_generated_column(mode: str = "stored") -> Generated:
    """Computed by the database in a way that isn't told here."""
    if mode not in ("stored", "virtual"):
        raise BehaviorError([("invalid-generated-mode", "generated", f"stored or virtual, not {mode!r}")])
    return Generated(None, mode)


def identity_column(mode: str = "always", dialect: str | None = None) -> Identity:
    if mode not in ("always", "by-default"):
        raise BehaviorError([("invalid-identity-mode", "identity", f"always or by-default, not {mode!r}")])
    return Identity(mode, dialect)


def _conflicts(c, made: bool):
    """(code, message) of every contradiction; made: whether an expression or the database computes the column."""
    defaults = c.default is not None or bool(c.has_default)
    if c.default is not None and c.has_default is False:
        yield "default-flag-conflict", "a default, and the flag that there is none"
    if c.default is not None and (made or c.identity or c.generated):
        yield "default-generated-conflict", "a generated column has no default"
    if (made or c.identity) and c.generated is False:
        yield "generated-flag-conflict", "generated, and the flag that it isn't"
    if made and c.identity:
        yield "identity-generated-conflict", "identity and generated expression"
    if made and defaults and c.default is None:
        yield "default-generated-conflict", "a generated column has no default"
    if c.identity and defaults and c.default is None:
        yield "identity-generated-conflict", "an identity column has no default"
    if c.on_update is not None and not (isinstance(c.on_update, Expr) and c.on_update.schema_safe):
        yield "invalid-on-update", "the expression isn't known to be deterministic"


def check_behavior(name: str, c):
    """The definition with consistent flags and plain descriptors; contradictions are errors, all told at once."""
    import dataclasses

    told = c.generated_as if isinstance(c.generated_as, Generated) else None
    made = c.generated_as is not None
    bad = [(code, name, message) for code, message in _conflicts(c, made)]
    if bad:
        raise BehaviorError(bad)
    return dataclasses.replace(
        c, has_default=bool(c.has_default) or c.default is not None, generated=bool(c.generated) or made or bool(c.identity), generated_as=told.expr if told else c.generated_as,
        virtual=told.mode == "virtual" if told else c.virtual, identity=Identity() if c.identity is True else c.identity, default=Default("external") if c.has_default and c.default is None else c.default,
    )


def resolve_column_behavior(name: str = "column", **options):
    """A definition's descriptors in plain form: what check_behavior() makes of a column with these options."""
    from ..sources import Column

    return check_behavior(name, Column(options.pop("domain", T.UNKNOWN), **options))


# --- registry ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Schema:
    """naming gives the physical name of a constraint or an index that has none, from its id."""

    tables: dict[str, Source]
    namespace: str | None = None
    naming: Callable[[str], str] = snake_case


default_naming_policy = snake_case


def generated_table_name(table_id: str, naming: Callable[[str], str] = default_naming_policy) -> str:
    return naming(table_id)


def schema(tables, namespace: str | None = None, naming: Callable[[str], str] = default_naming_policy) -> Schema:
    """A registry of tables by logical id; all problems are told at once."""
    pairs = list(tables.items()) if isinstance(tables, dict) else list(tables)
    bad, seen, physical = [], set(), {}
    for name, t in pairs:
        if not name or name != name.strip() or any(ch in "./\\" or ord(ch) < 32 for ch in name):
            bad.append(("invalid-table-id", name, "not a logical id"))
        if name in seen:
            bad.append(("duplicate-table-id", name, "used twice"))
        seen.add(name)
        if t.definition.name in physical:
            bad.append(("duplicate-physical-name", name, f"{t.definition.name} is also {physical[t.definition.name]}"))
        physical[t.definition.name] = name
        given: dict[str, str] = {}
        for key, c in (*t.definition.constraints.items(), *t.definition.indexes.items()):
            own = c.option("name") or naming(key)
            if own in given:
                bad.append(("generated-name-collision", f"{name}.{key}", f"{own} is also {given[own]}"))
            given[own] = key
    if namespace is not None and (not namespace or namespace != namespace.strip() or any(ch in "./\\\"'`" or ord(ch) < 32 for ch in namespace)):
        bad.append(("invalid-namespace", namespace, "not a namespace"))
    if bad:
        raise RegistryError(bad)
    return Schema(dict(pairs), namespace, naming)


# --- parameter-free text ----------------------------------------------------------------------------------------


def render_schema_expression(e: Expr, dialect=None, mode: str = "check") -> str:
    """SQL text without parameters, for defaults, generated columns, checks and indexes."""
    from ..render import Context, standard_dialect

    _safe(e, mode)
    if mode == "default" and e.columns:
        raise ExpressionError([("schema-expression", mode, "a default can't use columns")])
    ctx = _Literals(dialect or standard_dialect, bare=True)
    assert isinstance(ctx, Context)
    return e.render(ctx)


def _literals():
    from ..render import Context

    class Literals(Context):
        def parameter(self, x):
            x = canonical_literal(x)
            if x is None:
                return "NULL"
            if isinstance(x, bool):
                return self.dialect.true if x else self.dialect.false
            return self.literal(x) if isinstance(x, str) else repr(x)

    return Literals


def _Literals(*args, **kw):  # noqa: N802
    return _literals()(*args, **kw)


def normalize_schema_sql(sql: str) -> str:
    """The text with line ends of one character; nothing else changes."""
    return sql.replace("\r\n", "\n")


def unsafe_schema_sql(dialect: str, sql: str, domain: T.Domain = T.UNKNOWN) -> Expr:
    """Trusted SQL of one dialect for defaults, generated columns, checks and indexes; other dialects refuse it."""
    if not dialect.strip() or not sql.strip():
        raise ExpressionError([("invalid-schema-sql", "sql", "needs a dialect and a text")])
    sql = normalize_schema_sql(sql)

    def render(ctx):
        if not ctx.bare:
            raise T.QueryError("schema SQL belongs to schema metadata, not to a query")
        if ctx.dialect.name != dialect:
            raise T.CapabilityError(f"SQL of {dialect} in {ctx.dialect.name}")
        return sql

    return Expr("schema-sql", render, ("schema-sql", dialect, sql), domain, schema_safe=True)


def is_unsafe_schema_sql(x) -> bool:
    return isinstance(x, Expr) and x.kind == "schema-sql"


# --- snapshots --------------------------------------------------------------------------------------------------

#: This library's own document format.
FORMAT, VERSION = "quillon-schema", 2


def to_json_value(x, encoders: dict | None = None):
    """x as JSON has it: numbers that JSON lacks are tagged, keys are sorted; ``encoders`` turn further types into values."""
    return _plain(x, "$", encoders or {}, ())


def _plain(v, path: str, encoders: dict, above: tuple):
    for kind, encode in encoders.items():
        if isinstance(v, kind):
            return _plain(encode(v), path, {k: e for k, e in encoders.items() if k is not kind}, above)
    if isinstance(v, dict | list | tuple):
        if any(v is a for a in above):
            raise CanonicalError([("cycle", path, "the value holds itself")])
        above = (*above, v)
    if isinstance(v, dict):
        if not all(isinstance(k, str) for k in v):
            raise CanonicalError([("not-json", path, "keys must be strings")])
        return {k: _plain(v[k], f"{path}.{k}", encoders, above) for k in sorted(v)}
    if isinstance(v, list | tuple):
        return [_plain(y, f"{path}[{i}]", encoders, above) for i, y in enumerate(v)]
    if isinstance(v, float):
        if not math.isfinite(v):
            return {"~float": str(v)}
        return int(v) if v == int(v) and abs(v) < 2**53 else v
    if isinstance(v, int) and not isinstance(v, bool) and abs(v) >= 2**53:
        return {"~integer": str(v)}
    if v is None or isinstance(v, bool | int | str):
        return v
    raise CanonicalError([("not-json", path, f"{type(v).__name__} has no JSON")])


def canonical_json(x, encoders: dict | None = None) -> str:
    """The one text of a value: sorted keys, no blanks."""
    return json.dumps(to_json_value(x, encoders), separators=(",", ":"), ensure_ascii=False)


def _stored(e: Expr, mode: str = "check"):
    """Portable text, or the dialect and text of schema SQL that stands alone."""
    if is_unsafe_schema_sql(e):
        return {"dialect": e.key[1], "sql": e.key[2]}
    return render_schema_expression(e, mode=mode)


def _constraint(key: str, c: Constraint, names: dict, naming: Callable) -> dict:
    if c.kind == "index":
        terms = [{"expression": _stored(getattr(t, "expr", t)), "direction": getattr(t, "direction", None), "nulls": getattr(t, "nulls", None)} for t in c.columns]
        where = c.option("where")
        return {"kind": "index", "name": c.option("name") or naming(key), "terms": terms, "unique": c.option("unique"), "where": _stored(where) if where is not None else None, "include": sorted(names[i.key[2]] for i in c.option("include"))}
    out = {"kind": c.kind, "name": naming(key), "columns": [names[n] for n in c.columns]} | {k: v for k, v in c.options if isinstance(v, str | bool | int)}
    if c.kind == "foreign":
        source, columns = foreign_target(c)
        out |= {"target": source.definition.name, "targetColumns": [source.fields[n] for n in columns]}
    if c.kind == "check":
        out["expression"] = _stored(c.expr)
    return out


def _column(field: str, name: str, c, encoders: dict) -> dict:
    from ..sources import storage_of

    default = None
    if isinstance(c.default, Default):
        told = {"literal": lambda: {"value": to_json_value(c.default.value, encoders)}, "expression": lambda: {"sql": _stored(c.default.value, "default")}, "external": dict}
        default = {"kind": c.default.kind} | told[c.default.kind]()
    generated = None
    if c.generated and not c.identity:
        generated = {"mode": "virtual" if c.virtual else "stored", "sql": _stored(c.generated_as) if c.generated_as is not None else None}
    identity = {"mode": c.identity.mode, "dialect": c.identity.dialect} if c.identity else None
    return {"id": field, "name": name, "storage": storage_of(c), "nullable": c.nullable, "hasDefault": c.has_default, "generated": c.generated, "identity": identity, "default": default, "generatedAs": generated, "onUpdate": _stored(c.on_update) if isinstance(c.on_update, Expr) else None}


def create_snapshot(s: Schema, adapter: Callable | None = None, encoders: dict | None = None) -> dict:
    """A registry as a plain document; tables and columns sorted by id. ``adapter`` may check and map it."""
    tables = []
    for table_id in sorted(s.tables):
        t = s.tables[table_id]
        d = t.definition
        parts = {part: {k: _constraint(k, found[k], t.fields, s.naming) for k in sorted(found)} for part, found in (("constraints", d.constraints), ("indexes", d.indexes))}
        tables.append({"id": table_id, "name": d.name, "columns": [_column(f, t.fields[f], d.columns[f], encoders or {}) for f in sorted(d.columns)], **parts})
    out = {"format": FORMAT, "version": VERSION, "namespace": s.namespace, "tables": tables}
    return adapter(out) if adapter else out


serialize_schema = create_snapshot


def try_create_snapshot(s: Schema, adapter: Callable | None = None, encoders: dict | None = None) -> tuple[dict | None, list[tuple]]:
    """(snapshot, []) or (None, diagnostics): the document is checked as decode_snapshot() does."""
    try:
        return decode_snapshot(create_snapshot(s, adapter, encoders)), []
    except SchemaError as e:
        return None, e.diagnostics
    except T.QueryError as e:
        return None, [("unsupported-dialect-option", "$", str(e))]


def encode_snapshot(snapshot: dict) -> str:
    return canonical_json(snapshot)


def snapshot_digest(snapshot: dict | str) -> str:
    """FNV-1a, 64 bits, over the canonical UTF-8 text."""
    text = snapshot if isinstance(snapshot, str) else encode_snapshot(snapshot)
    # Fixed values of the algorithm: offset basis and prime.
    h, prime = 0xCBF29CE484222325, 0x100000001B3
    for b in text.encode():
        h = (h ^ b) * prime % 2**64
    return f"quillon-fnv64-{h:016x}"


from .documents import assert_snapshot, canonicalize_snapshot, decode_snapshot  # noqa: E402, F401
