"""What a snapshot document may hold: shapes of its nodes, and references between them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from .. import types as T
from . import FORMAT, VERSION, SnapshotError, canonical_json

Found = Iterator[tuple[str, str, str]]


def text(v, path) -> Found:
    if not isinstance(v, str) or not v.strip():
        yield "invalid-value", path, "a text that isn't blank"


def flag(v, path) -> Found:
    if not isinstance(v, bool):
        yield "invalid-value", path, "true or false"


def literal(v, path) -> Found:
    tagged = isinstance(v, dict) and set(v) in ({"~float"}, {"~integer"}) and all(isinstance(x, str) for x in v.values())
    if not (v is None or isinstance(v, bool | int | float | str) or tagged):
        yield "invalid-value", path, "a literal"


def one_of(*values) -> Callable:
    def shape(v, path) -> Found:
        if not any(type(v) is type(x) and v == x for x in values):
            yield "invalid-value", path, f"one of {list(values)}"

    return shape


def maybe(inner: Callable) -> Callable:
    def shape(v, path) -> Found:
        if v is not None:
            yield from inner(v, path)

    return shape


def several(inner: Callable, least: int = 0) -> Callable:
    def shape(v, path) -> Found:
        if not isinstance(v, list) or len(v) < least:
            yield "invalid-value", path, f"a list of {least} or more"
            return
        for i, x in enumerate(v):
            yield from inner(x, f"{path}[{i}]")

    return shape


def named(inner: Callable) -> Callable:
    """An object whose keys are ids in ascending order."""

    def shape(v, path) -> Found:
        if not isinstance(v, dict):
            yield "invalid-value", path, "an object"
            return
        if list(v) != sorted(v) or any(not k.strip() for k in v):
            yield "unsorted-ids", path, "ids are sorted and not blank"
        for k, x in v.items():
            yield from inner(x, f"{path}.{k}")

    return shape


def fields(must: dict, may: dict | None = None) -> Callable:
    """An object with these fields and no others."""

    def shape(v, path) -> Found:
        if not isinstance(v, dict):
            yield "invalid-value", path, "an object"
            return
        for k in sorted(set(must) - set(v)):
            yield "missing-field", f"{path}.{k}", "isn't there"
        for k in sorted(set(v) - set(must) - set(may or {})):
            yield "unknown-field", f"{path}.{k}", "isn't known"
        for k, inner in {**must, **(may or {})}.items():
            if k in v:
                yield from inner(v[k], f"{path}.{k}")

    return shape


def by(key: str, shapes: dict[str, Callable]) -> Callable:
    """An object whose field ``key`` says what the others are."""

    def shape(v, path) -> Found:
        kind = v.get(key) if isinstance(v, dict) else None
        if not isinstance(kind, str) or kind not in shapes:
            yield "invalid-value", f"{path}.{key}", f"one of {sorted(shapes)}"
            return
        yield from shapes[kind](v, path)

    return shape


def sql(v, path) -> Found:
    """A portable text, or the dialect and text of one database."""
    yield from (fields({"dialect": text, "sql": text}) if isinstance(v, dict) else text)(v, path)


_DOMAINS = [d.name for d in (T.UNKNOWN, T.TEXT, T.UUID, T.INTEGER, T.DECIMAL, T.BIGINT, T.BOOLEAN, T.DATE, T.TIMESTAMP, T.JSON, T.BINARY)]
_ACTIONS = one_of("cascade", "restrict", "no action", "no-action", "set null", "set-null", "set default", "set-default")
_LATE = {"deferrable": flag, "initially": one_of("deferred", "immediate")}
_KEY = {"kind": text, "name": text, "columns": several(text, 1)}

STORAGE = by("kind", {"portable": fields({"kind": text, "type": one_of(*_DOMAINS)}), "native": fields({"kind": text, "dialect": text, "declaration": text})})
DEFAULT = by("kind", {"literal": fields({"kind": text, "value": literal}), "expression": fields({"kind": text, "sql": sql}), "external": fields({"kind": text})})
COLUMN = fields({
    "id": text, "name": text, "storage": STORAGE, "nullable": flag, "hasDefault": flag, "generated": flag, "default": maybe(DEFAULT), "onUpdate": maybe(sql),
    "identity": maybe(fields({"mode": one_of("always", "by-default"), "dialect": maybe(text)})), "generatedAs": maybe(fields({"mode": one_of("stored", "virtual"), "sql": maybe(sql)})),
})
CONSTRAINT = by("kind", {
    "primary": fields(_KEY, _LATE), "unique": fields(_KEY, _LATE), "unique-nullable": fields(_KEY, {"nulls_distinct": flag, **_LATE}),
    "foreign": fields({**_KEY, "target": text, "targetColumns": several(text, 1)}, {"match": one_of("simple", "full", "partial"), "on_delete": _ACTIONS, "on_update": _ACTIONS, **_LATE}),
    "check": fields({"kind": text, "name": text, "columns": several(text), "expression": sql}, _LATE),
})
TERM = fields({"expression": sql, "direction": maybe(one_of("ASC", "DESC")), "nulls": maybe(one_of("FIRST", "LAST"))})
INDEX = fields({"kind": one_of("index"), "name": text, "terms": several(TERM, 1), "unique": flag, "where": maybe(sql), "include": several(text)})
TABLE = fields({"id": text, "name": text, "columns": several(COLUMN, 1), "constraints": named(CONSTRAINT), "indexes": named(INDEX)})
DOCUMENT = fields({"format": one_of(FORMAT), "version": one_of(VERSION), "namespace": maybe(text), "tables": several(TABLE)})


def _references(d: dict) -> Found:
    """What the shapes can't tell: order, repeated names, columns and tables that aren't there, contradictions."""
    names = {t["name"]: {c["name"] for c in t["columns"]} for t in d["tables"]}
    groups = [("$.tables", d["tables"])] + [(f"$.tables[{i}].columns", t["columns"]) for i, t in enumerate(d["tables"])]
    for path, nodes in groups:
        ids, held = [x["id"] for x in nodes], [x["name"] for x in nodes]
        if ids != sorted(set(ids)):
            yield "unsorted-ids", path, "ids are sorted and unique"
        if len(set(held)) < len(held):
            yield "duplicate-name", path, "physical names are unique"
    for i, t in enumerate(d["tables"]):
        own = names[t["name"]]
        held = [c["name"] for part in ("constraints", "indexes") for c in t[part].values()]
        if len(set(held)) < len(held):
            yield "duplicate-name", f"$.tables[{i}]", "names of constraints and indexes are unique"
        for j, c in enumerate(t["columns"]):
            path = f"$.tables[{i}].columns[{j}]"
            if (c["default"] is not None) != c["hasDefault"]:
                yield "default-flag-conflict", path, "hasDefault says whether there is a default"
            if (c["identity"] is not None or c["generatedAs"] is not None) != c["generated"]:
                yield "generated-flag-conflict", path, "generated says whether the database makes the value"
            if c["identity"] is not None and c["generatedAs"] is not None:
                yield "identity-generated-conflict", path, "identity and generated"
            if c["generated"] and c["hasDefault"]:
                yield "default-generated-conflict", path, "a generated column has no default"
        for k, c in t["constraints"].items():
            path = f"$.tables[{i}].constraints.{k}"
            if not set(c["columns"]) <= own:
                yield "unknown-column", path, str(sorted(set(c["columns"]) - own))
            if len(set(c["columns"])) < len(c["columns"]):
                yield "duplicate-column", path, "a column stands twice"
            if c["kind"] == "foreign":
                if c["target"] not in names or not set(c["targetColumns"]) <= names[c["target"]]:
                    yield "unknown-target", path, c["target"]
                elif len(c["targetColumns"]) != len(c["columns"]):
                    yield "foreign-key-arity", path, "as many columns as the target has"
            if c["kind"] == "primary" and any(x["nullable"] for x in t["columns"] if x["name"] in c["columns"]):
                yield "nullable-key", path, "a primary key isn't nullable"
        if sum(c["kind"] == "primary" for c in t["constraints"].values()) > 1:
            yield "duplicate-primary-key", f"$.tables[{i}]", "one primary key"
        for k, x in t["indexes"].items():
            if x["include"] != sorted(set(x["include"])) or not set(x["include"]) <= own:
                yield "unknown-column", f"$.tables[{i}].indexes.{k}.include", "sorted columns of the table"


def diagnose(document) -> list[tuple[str, str, str]]:
    """All (code, path, message) about a document; its references are looked at once its shape is right."""
    if isinstance(document, dict) and document.get("format") == FORMAT and document.get("version") != VERSION:
        return [("unsupported-version", "$.version", f"version {document.get('version')}")]
    found = list(DOCUMENT(document, "$"))
    return found or list(_references(document))


def assert_snapshot(document) -> None:
    if found := diagnose(document):
        raise SnapshotError(found)


def decode_snapshot(document: str | dict) -> dict:
    """A checked snapshot: other versions, fields, types and values, unsorted or repeated ids, dangling names are errors."""
    try:
        d = json.loads(document) if isinstance(document, str) else document
    except json.JSONDecodeError as e:
        raise SnapshotError([("invalid-json", "$", str(e))]) from e
    assert_snapshot(d)
    return d


def canonicalize_snapshot(document: str | dict) -> str:
    """The canonical text of a checked snapshot."""
    return canonical_json(decode_snapshot(document))
