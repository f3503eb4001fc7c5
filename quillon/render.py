"""Queries as SQL text with ordered parameters, for several dialects; Spark runs the text of its own dialect."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from . import types as T
from .naming import sql_names
from .nodes import Query

#: How each logical type is spelled in a CAST (fixed values).
STANDARD_TYPES = {"integer": "INTEGER", "decimal": "DECIMAL", "text": "TEXT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "uuid": "UUID", "json": "JSON", "bigint": "BIGINT", "binary": "VARBINARY"}
POSTGRES_TYPES = STANDARD_TYPES | {"binary": "BYTEA"}
SQLITE_TYPES = STANDARD_TYPES | {"decimal": "NUMERIC", "boolean": "INTEGER", "date": "TEXT", "timestamp": "TEXT", "uuid": "TEXT", "json": "TEXT", "binary": "BLOB"}
MYSQL_TYPES = STANDARD_TYPES | {"integer": "SIGNED", "bigint": "SIGNED", "text": "CHAR", "uuid": "CHAR", "boolean": "UNSIGNED", "timestamp": "DATETIME", "binary": "BINARY"}
SPARK_TYPES = STANDARD_TYPES | {"decimal": "DECIMAL(38,18)", "text": "STRING", "uuid": "STRING", "binary": "BINARY"}


def _fetch(ctx, offset, fetch):
    out = [f"OFFSET {ctx.parameter(offset)} ROWS"] if offset is not None else []
    return " ".join(out + ([f"FETCH FIRST {ctx.parameter(fetch)} ROWS ONLY"] if fetch is not None else []))


def _limit(everything: str | None):
    def page(ctx, offset, fetch):
        out = [f"LIMIT {ctx.parameter(fetch)}"] if fetch is not None else [f"LIMIT {everything}"] if everything and offset is not None else []
        return " ".join(out + ([f"OFFSET {ctx.parameter(offset)}"] if offset is not None else []))

    return page


def _json_standard(ctx, kind, doc, path):
    text = "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{json.dumps(p, ensure_ascii=False)}" for p in path)
    own = lambda: f"{doc.render(ctx)}, {ctx.literal(text)}"
    if kind == "exists":
        return f"JSON_EXISTS({own()})"
    name = {"text": "VARCHAR", "number": "DECIMAL", "boolean": "BOOLEAN"}[kind]
    return f"JSON_VALUE({own()} RETURNING {name} NULL ON EMPTY NULL ON ERROR)"


def _json_postgres(ctx, kind, doc, path):
    text = "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{json.dumps(p, ensure_ascii=False)}" for p in path)
    if kind == "exists":
        return f"COALESCE(jsonb_path_exists(CAST({doc.render(ctx)} AS JSONB), {ctx.literal(text)}), FALSE)"
    found = f"jsonb_path_query_first(CAST({doc.render(ctx)} AS JSONB), {ctx.literal(text + ' ? (@.type() == ' + json.dumps({'text': 'string'}.get(kind, kind)) + ')')}) #>> '{{}}'"
    return {"text": f"({found})", "number": f"CAST({found} AS NUMERIC)", "boolean": f"CAST({found} AS BOOLEAN)"}[kind]


def _json_sqlite(ctx, kind, doc, path):
    text = "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{json.dumps(p, ensure_ascii=False)}" for p in path)
    own = lambda: f"{doc.render(ctx)}, {ctx.literal(text)}"
    if kind == "exists":
        return f"(json_type({own()}) IS NOT NULL)"
    kinds = {"text": "'text'", "number": "'integer', 'real'", "boolean": "'true', 'false'"}[kind]
    return f"CASE WHEN json_type({own()}) IN ({kinds}) THEN json_extract({own()}) END"


def _json_mysql(ctx, kind, doc, path):
    text = "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{json.dumps(p, ensure_ascii=False)}" for p in path)
    own = lambda: f"{doc.render(ctx)}, {ctx.literal(text)}"
    if kind == "exists":
        return f"COALESCE(JSON_CONTAINS_PATH({doc.render(ctx)}, 'one', {ctx.literal(text)}), FALSE)"
    kinds = {"text": "'STRING'", "number": "'INTEGER', 'DOUBLE', 'DECIMAL', 'UNSIGNED INTEGER'", "boolean": "'BOOLEAN'"}[kind]
    value = f"JSON_UNQUOTE(JSON_EXTRACT({own()}))"
    value = {"text": value, "number": f"CAST({value} AS DECIMAL(65, 30))", "boolean": f"({value} = 'true')"}[kind]
    return f"CASE WHEN JSON_TYPE(JSON_EXTRACT({own()})) IN ({kinds}) THEN {value} END"


def _json_spark(ctx, kind, doc, path):
    """Guarded by the variant's own type: get_json_object would turn numbers into text."""
    text = "$" + "".join(f"[{p}]" if isinstance(p, int) else (f"['{p}']" if "'" not in p else f'["{p}"]') for p in path)
    if any(isinstance(p, str) and "'" in p and '"' in p for p in path):
        raise T.UnsupportedError("a JSON key with both kinds of quotes can't be asked for in Spark")
    variant = lambda: f"TRY_PARSE_JSON(CAST({doc.render(ctx)} AS STRING))"
    if kind == "exists":
        return f"(TRY_VARIANT_GET({variant()}, {ctx.literal(text)}, 'variant') IS NOT NULL)"
    own = f"SCHEMA_OF_VARIANT(TRY_VARIANT_GET({variant()}, {ctx.literal(text)}, 'variant'))"
    guard = {"text": f"{own} = 'STRING'", "number": f"{own} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$'", "boolean": f"{own} = 'BOOLEAN'"}[kind]
    name = {"text": "string", "number": "double", "boolean": "boolean"}[kind]
    return f"CASE WHEN {guard} THEN TRY_VARIANT_GET({variant()}, {ctx.literal(text)}, '{name}') END"


@dataclass(frozen=True)
class Dialect:
    """A dialect; create_dialect() derives others."""

    name: str
    quote: str = '"'
    placeholder: Callable = lambda n: "?"
    page: Callable = _fetch
    json: Callable = _json_standard
    types: dict = field(default_factory=lambda: STANDARD_TYPES)
    capabilities: frozenset = frozenset(["json"])
    ilike: str = "ILIKE"
    true: str = "TRUE"
    false: str = "FALSE"

    def cast(self, text: str, target) -> str:
        if self.name == "spark" and target.domain == T.JSON and not target.cast_type:
            return f"TRY_PARSE_JSON({text})"
        name = target.cast_type or (target.native[1] if target.native else self.types.get(target.domain.name))
        if name is None:
            raise T.CapabilityError(f"{self.name} has no CAST to {target.domain.name}")
        return f"CAST({text} AS {name})"


standard_dialect = Dialect("standard-sql")
postgres_dialect = Dialect("postgresql", placeholder=lambda n: f"${n}", page=_limit(None), json=_json_postgres, types=POSTGRES_TYPES, capabilities=frozenset(["ilike", "json"]))
sqlite_dialect = Dialect("sqlite", page=_limit("-1"), json=_json_sqlite, types=SQLITE_TYPES, true="1", false="0")
mysql_dialect = Dialect("mysql", quote="`", page=_limit("18446744073709551615"), json=_json_mysql, types=MYSQL_TYPES)
spark_dialect = Dialect("spark", quote="`", placeholder=lambda n: f":p{n}", page=_limit("ALL"), json=_json_spark, types=SPARK_TYPES, capabilities=frozenset(["ilike", "json"]))


def create_dialect(base: Dialect = standard_dialect, **changes) -> Dialect:
    """``base`` with other settings."""
    return dataclasses.replace(base, **changes)


def assert_dialect_capability(dialect: Dialect, capability: str) -> None:
    if capability not in dialect.capabilities:
        raise T.CapabilityError(f"{dialect.name} has no {capability}")


#: A column of the query just outside, in a condition of a select.
_NEAR = re.compile("\2(.*?)\3", re.S)


@dataclass(eq=False)
class Frame:
    """One select that is being rendered for Spark: its depth in subqueries and its sources, the first one the host.

    Spark resolves a column of the query just outside, not of one beyond. Such a column is carried: the query
    between gives it out as a further column of its host. Conditions of joins see the host if it is alone in FROM.
    """

    level: int
    sources: tuple
    host: object = None
    alone: bool = False
    carried: dict = field(default_factory=dict)
    compared: dict = field(default_factory=dict)

    def carry(self, ctx, text: str) -> str:
        if self.host is None:
            raise T.UnsupportedError("correlation over two levels needs a source in FROM, not made nullable by a join, in the query between")
        return f"{ctx.quote(self.host.name)}.{ctx.quote(self.carried.setdefault(text, f'_outer{len(self.carried)}'))}"

    def compare(self, ctx, text: str) -> str:
        """A column of the query just outside, in a condition: carried as well where others are."""
        if not self.carried:
            return text
        return f"{ctx.quote(self.host.name)}.{ctx.quote(self.carried.get(text) or self.compared.setdefault(text, f'_near{len(self.compared)}'))}"

    def hosted(self, ctx, text: str) -> str:
        """The select's text with the host between marks as it is, or with what it carries.

        A select that carries columns carries those that its conditions compare too: Spark then joins the carried values
        by these conditions, where it would pair each of them with every row.
        """
        text = _NEAR.sub(lambda m: self.compare(ctx, m[1]), text)
        before, mark, rest = text.partition("\0")
        if not mark:
            return text
        host, _, after = rest.partition("\1")
        for columns in filter(None, (self.carried, self.compared)):
            more = ", ".join(f"{t} AS {ctx.quote(a)}" for t, a in columns.items())
            host = f"(SELECT *, {more} FROM {host}) AS {ctx.quote(self.host.name)}"
        return before + host + after


@dataclass
class Context:
    """State of one rendering: parameters in textual order, CTEs in scope, and where the text stands."""

    dialect: Dialect
    parameters: list = field(default_factory=list)
    ctes: set = field(default_factory=set)
    embedded: bool = False
    conjunct: bool = False
    condition: bool = False
    bare: bool = False
    extra: list = field(default_factory=list)
    level: int = 0
    frames: tuple = ()
    relations: Callable | None = None

    def quote(self, name: str) -> str:
        q = self.dialect.quote
        return q + name.replace(q, q + q) + q

    def table(self, name: str, alias: str | None = None) -> str:
        """A base table in FROM; an engine may hold it under another name, which ``relations`` gives."""
        held = self.relations(name) if self.relations else name
        return self.quote(held) + (f" AS {self.quote(alias or name)}" if alias or held != name else "")

    def literal(self, text: str) -> str:
        if self.dialect.name in ("spark", "mysql"):
            text = text.replace("\\", "\\\\")
        return "'" + text.replace("'", "\\'" if self.dialect.name == "spark" else "''") + "'"

    def parameter(self, x) -> str:
        self.parameters.append(x)
        return self.dialect.placeholder(len(self.parameters))

    def operator(self, op: str) -> str:
        return self.dialect.ilike if op == "ILIKE" else op

    def query(self, extra, sources=(), host=None, alone=False) -> Context:
        """The context of one select: CTEs that it binds aren't seen outside."""
        return dataclasses.replace(self, ctes=set(self.ctes), extra=extra, conjunct=False, condition=False, frames=(*self.frames, Frame(self.level, tuple(sources), host, alone)))

    def relation(self) -> Context:
        return dataclasses.replace(self, embedded=True, conjunct=False, condition=False)

    def inner(self) -> Context:
        """The context of a subquery or a lateral, one level deeper than a derived table."""
        return dataclasses.replace(self.relation(), level=self.level + 1)

    def reference(self, source, text: str) -> str:
        """A column of ``source``, carried over the levels between where the dialect is Spark's."""
        if self.dialect.name != "spark":
            return text
        owner = next((f for f in reversed(self.frames) if any(s is source for s in f.sources)), None)
        while owner is not None and self.level - owner.level > 1:
            owner = next(f for f in reversed(self.frames) if f.level == owner.level + 1)
            text = owner.carry(self, text)
        return f"\2{text}\3" if self.condition and owner is not None and owner.level < self.level == self.frames[-1].level else text

    def marked(self, text: str) -> str:
        """The first source of FROM, so that it can be told to carry columns."""
        return f"\0{text}\1" if self.dialect.name == "spark" and self.frames else text

    def arm(self) -> Context:
        return dataclasses.replace(self, conjunct=False)

    def top(self) -> Context:
        return dataclasses.replace(self, conjunct=True)

    def per_row(self) -> Context:
        """The context of a condition on rows of FROM, which what is carried may stand in."""
        return dataclasses.replace(self, condition=True)

    def result_names(self, fields) -> list[str]:
        return list(sql_names({f: None for f in fields}).values()) if self.embedded else list(fields)

    def determined(self) -> list[str]:
        """Columns that grouped keys determine; only Spark has to be told."""
        return [e.render(self) for e in self.extra] if self.dialect.name == "spark" else []


@dataclass(frozen=True)
class Rendered:
    text: str
    parameters: tuple


def render(query: Query, dialect: Dialect = standard_dialect, relations: Callable | None = None) -> Rendered:
    """Text and parameters; the order of parameters is that of their placeholders in the text.

    ``relations`` gives the names that tables are held under, where these aren't their own.
    """
    for c in query.capabilities:
        assert_dialect_capability(dialect, c)
    if query.outer:
        raise T.ScopeError(f"needs sources of an enclosing query: {', '.join(sorted(s.name for s in query.outer))}")
    ctx = Context(dialect, relations=relations)
    text = query.render(ctx)
    return Rendered(text, tuple(ctx.parameters))


to_sql = render
