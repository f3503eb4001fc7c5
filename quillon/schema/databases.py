"""Snapshots for one database: what its tables can't hold is told as diagnostics, all at once.

Each database is a value of facts; one walk over the registry compares every table with them.
"""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass
from typing import TYPE_CHECKING

from ..nodes import Expr
from . import Constraint, Schema, SchemaError, create_snapshot, is_unsafe_schema_sql, render_schema_expression

if TYPE_CHECKING:
    from ..render import Dialect

#: How each logical type is declared (fixed values).
POSTGRES_STORAGE = {"integer": "INTEGER", "decimal": "NUMERIC", "text": "TEXT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "uuid": "UUID", "json": "JSONB", "bigint": "BIGINT", "binary": "BYTEA"}
SQLITE_STORAGE = {"integer": "INTEGER", "decimal": "NUMERIC", "text": "TEXT", "boolean": "INTEGER", "date": "TEXT", "timestamp": "TEXT", "uuid": "TEXT", "json": "TEXT", "bigint": "INTEGER", "binary": "BLOB"}
SPARK_STORAGE = {"integer": "INT", "decimal": "DOUBLE", "text": "STRING", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "uuid": "STRING", "json": "STRING", "bigint": "BIGINT", "binary": "BINARY"}
MYSQL_STORAGE = {"integer": "INT", "decimal": "DECIMAL", "text": "TEXT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "DATETIME", "uuid": "CHAR(36)", "json": "JSON", "bigint": "BIGINT", "binary": "VARBINARY"}


@dataclass(frozen=True, eq=False)
class Database:
    """What a database can hold; deferrable names the kinds of constraints that may be deferred."""

    name: str
    storage: dict
    name_limit: int | None = None
    name_bytes: bool = False
    virtual: bool = True
    on_update: bool = False
    deferrable: frozenset = frozenset()
    matches: frozenset = frozenset(["simple"])
    set_default: bool = True
    include: bool = False
    partial_index: bool = True
    null_order: bool = True


postgres_database = Database("postgresql", POSTGRES_STORAGE, 63, True, virtual=False, deferrable=frozenset(["primary", "unique", "unique-nullable", "foreign"]), matches=frozenset(["simple", "full"]), include=True)
sqlite_database = Database("sqlite", SQLITE_STORAGE, deferrable=frozenset(["foreign"]))
mysql_database = Database("mysql", MYSQL_STORAGE, 64, on_update=True, set_default=False, partial_index=False, null_order=False)
#: Spark holds constraints and computed columns as metadata alone; the engine computes the latter, and stores them.
spark_database = Database("spark", SPARK_STORAGE, 255, virtual=False, on_update=True, deferrable=frozenset(), set_default=False, partial_index=False)


def affinity(declaration: str) -> str:
    """The SQLite affinity of a declared type."""
    d = declaration.upper()
    if "INT" in d:
        return "integer"
    if any(w in d for w in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if not d.strip() or "BLOB" in d:
        return "blob"
    return "real" if any(w in d for w in ("REAL", "FLOA", "DOUB")) else "numeric"


def _storage(c, db: Database) -> str | None:
    """The declaration of a column, or None if it belongs to another database or there is none."""
    if c.native:
        return c.native[1] if c.native[0] == db.name and c.native[1].strip() else None
    return db.storage.get(c.domain.name)


def _foreign_sql(e, db: Database):
    """Messages about SQL of other dialects in an expression."""
    if is_unsafe_schema_sql(e) and e.key[1] != db.name:
        yield f"SQL of {e.key[1]}"
    for x in getattr(e, "inner", ()):
        yield from _foreign_sql(x, db)


def _leads_key(field: str, definition) -> bool:
    for c in (*definition.constraints.values(), *definition.indexes.values()):
        first = c.columns[0] if c.columns else None
        first = getattr(first, "expr", first)
        if c.kind in ("primary", "unique", "unique-nullable") and first == field:
            return True
        if c.kind == "index" and c.option("where") is None and first.kind == "column" and first.key[2] == field:
            return True
    return False


def _identity(field, c, definition, declared, db):
    primary = next((k.columns for k in definition.constraints.values() if k.kind == "primary"), ())
    if db.name == "sqlite":
        if affinity(declared or "") != "integer":
            yield "an identity column has INTEGER affinity"
        if primary != (field,):
            yield "an identity column is the sole column of the primary key"
    if db.name == "mysql":
        if c.nullable:
            yield "an AUTO_INCREMENT column isn't nullable"
        if not re.match(r"\s*(TINY|SMALL|MEDIUM|BIG)?INT(EGER)?\b", declared or "", re.IGNORECASE):
            yield "an AUTO_INCREMENT column is declared as an integer"
        if not _leads_key(field, definition):
            yield "an AUTO_INCREMENT column is the first of a key"


def _column(field, c, definition, db):
    declared = _storage(c, db)
    if declared is None:
        yield "storage", f"no {db.name} storage for " + (f"{c.native[1]!r} of {c.native[0]}" if c.native else c.domain.name)
    for part, e in (("default", getattr(c.default, "value", None)), ("generated", c.generated_as), ("onUpdate", c.on_update)):
        for message in _foreign_sql(e, db):
            yield part, message
    if c.on_update is not None and not db.on_update:
        yield "onUpdate", f"{db.name} has no ON UPDATE"
    if c.on_update is not None and c.generated_as is not None:
        yield "onUpdate", "a generated column has no ON UPDATE"
    if c.generated_as is not None:
        if c.virtual and not db.virtual:
            yield "generated", f"{db.name} stores generated columns"
        if db.name == "sqlite" and any(k.kind == "primary" and field in k.columns for k in definition.constraints.values()):
            yield "generated", "a generated column isn't part of the primary key"
    if c.identity:
        for message in _identity(field, c, definition, declared, db):
            yield "identity", message


def _constraint(c: Constraint, db: Database):
    for e in (c.expr, c.option("where"), *(getattr(t, "expr", t) for t in c.columns)):
        yield from _foreign_sql(e, db)
    deferred, initially = c.option("deferrable", False), str(c.option("initially", "")).lower()
    if deferred and c.kind not in db.deferrable:
        yield f"a {c.kind} constraint can't be deferred in {db.name}"
    if initially == "deferred" and not deferred:
        yield "initially deferred without deferrable"
    if c.kind == "unique-nullable" and not c.option("nulls_distinct", True):
        yield "NULLS NOT DISTINCT isn't supported"
    if c.kind == "foreign":
        match = str(c.option("match", "simple")).lower()
        if match not in db.matches:
            yield f"MATCH {match.upper()} isn't supported"
        if not db.set_default and "set default" in {str(c.option(a, "")).lower().replace("-", " ") for a in ("on_delete", "on_update")}:
            yield "SET DEFAULT isn't supported"
    if c.kind == "index":
        if c.option("include") and not db.include:
            yield "an index includes no columns"
        if c.option("where") is not None and not db.partial_index:
            yield "an index has no condition"
        if not db.null_order and any(getattr(t, "nulls", None) for t in c.columns):
            yield "an index has no order of nulls"


def validate_constraint(c: Constraint, db: Database, path: str = "$") -> list[tuple]:
    """(code, path, message) about what the database can't hold of a constraint."""
    if c.kind == "index":
        raise ValueError("an index is checked by validate_index()")
    return [("unsupported-dialect-option", path, m) for m in _constraint(c, db)]


def validate_index(c: Constraint, db: Database, path: str = "$") -> list[tuple]:
    """(code, path, message) about what the database can't hold of an index."""
    if c.kind != "index":
        raise ValueError("a constraint is checked by validate_constraint()")
    return [("unsupported-dialect-option", path, m) for m in _constraint(c, db)]


@dataclass(frozen=True, eq=False)
class SchemaDialect:
    """A dialect with what its database can hold; ``checks`` are further functions of (registry, database) -> diagnostics."""

    dialect: Dialect
    database: Database
    checks: tuple = ()

    def diagnostics(self, s: Schema) -> list[tuple]:
        return diagnostics(s, self.database) + [d for check in self.checks for d in check(s, self.database)]

    def render(self, e: Expr, mode: str = "check") -> str:
        return render_schema_expression(e, self.dialect, mode)


def create_schema_dialect(dialect: Dialect, database: Database, *checks, **changes) -> SchemaDialect:
    """``changes`` are other facts of the database than the given one's."""
    return SchemaDialect(dialect, dataclasses.replace(database, **changes), checks)


def spark_types(document: dict) -> dict:
    """StructTypes by table id from a snapshot for Spark, the names physical."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    out = {}
    for t in document["tables"]:
        if any(c["storage"].get("dialect") != "spark" for c in t["columns"]):
            raise SchemaError([("foreign-storage", f"$.tables.{t['id']}", "not a snapshot for Spark")])
        out[t["id"]] = StructType([StructField(c["name"], _parse_datatype_string(c["storage"]["declaration"]), c["nullable"]) for c in t["columns"]])
    return out


def diagnostics(s: Schema, db: Database) -> list[tuple]:
    """All (code, path, message) about what the database can't hold; names too long count."""
    out = []

    def named(name, path):
        size = len(name.encode()) if db.name_bytes else len(name)
        if db.name_limit is not None and size > db.name_limit:
            out.append(("name-too-long", path, f"{size} of {db.name_limit} {'bytes' if db.name_bytes else 'characters'}"))

    if s.namespace is not None:
        named(s.namespace, "$.namespace")
    for table_id in sorted(s.tables):
        t, path = s.tables[table_id], f"$.tables.{table_id}"
        named(t.definition.name, path)
        for field in sorted(t.definition.columns):
            named(t.fields[field], f"{path}.columns.{field}")
            out += [("unsupported-dialect-option", f"{path}.columns.{field}.{part}", m) for part, m in _column(field, t.definition.columns[field], t.definition, db)]
        for part, found in (("constraints", t.definition.constraints), ("indexes", t.definition.indexes)):
            for key in sorted(found):
                named(found[key].option("name") or key, f"{path}.{part}.{key}")
                out += [("unsupported-dialect-option", f"{path}.{part}.{key}", m) for m in _constraint(found[key], db)]
    return out


def try_create_database_snapshot(s: Schema, db: Database) -> tuple[dict | None, list[tuple]]:
    """(snapshot with the database's storage, []) or (None, diagnostics)."""
    bad = diagnostics(s, db)
    if bad:
        return None, bad

    def stored(document):
        for t in document["tables"]:
            for c in t["columns"]:
                c["storage"] = {"kind": "native", "dialect": db.name, "declaration": _storage(s.tables[t["id"]].definition.columns[c["id"]], db)}
        return document

    return create_snapshot(s, stored), []


def create_database_snapshot(s: Schema, db: Database) -> dict:
    """As try_create_database_snapshot, but diagnostics are raised together."""
    document, bad = try_create_database_snapshot(s, db)
    if bad:
        raise SchemaError(bad)
    return document
