"""Runs queries on Spark: select queries become lazy DataFrames, mutations new versions of a table."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as T
from ..extension import MUTATIONS
from ..naming import fresh
from ..nodes import Expr, Query, Source, as_expr
from ..operators.select import select
from ..operators.clauses import from_
from ..render import Context, Dialect, Rendered, render, spark_dialect
from ..schema import Default, render_schema_expression


@dataclass(frozen=True)
class Adapter:
    """What execute() needs: a dialect and a function of the rendered statement.

    encode is applied to every parameter; relations gives the names that tables are held under, where not their own.
    """

    run: Callable
    dialect: Dialect = spark_dialect
    encode: Callable | None = None
    relations: Callable | None = None


class DriverValueEncoder:
    """Parameters as a driver takes them: encode(value) for every one; a subclass or a mapping of types to functions."""

    def __init__(self, by_type: dict[type, Callable] | None = None):
        self.by_type = by_type or {}

    def encode(self, value):
        for kind in type(value).__mro__:
            if kind in self.by_type:
                return self.by_type[kind](value)
        return value

    __call__ = lambda self, value: self.encode(value)


def execute(query, adapter, dialect: Dialect | None = None):
    """Render and hand over; the arguments may stand in either order, and errors pass through."""
    if isinstance(adapter, Query):
        query, adapter = adapter, query
    statement = render(query, dialect or adapter.dialect, adapter.relations)
    return adapter.run(Rendered(statement.text, tuple(map(adapter.encode, statement.parameters))) if adapter.encode else statement)


execute_query = execute


def _drop_views(spark: SparkSession, names: set) -> None:
    if spark.sparkContext._jsc is not None:  # else the session has ended, and its views with it
        for name in names:
            spark.catalog.dropTempView(name)


class _Tables(dict):
    """DataFrames by name; those that are given as functions are made when they are first asked for."""

    def __init__(self, load):
        super().__init__()
        self.load = load

    def __missing__(self, name):
        return self.load(name)


class Engine:
    """Tables by physical name and a session; a table is a DataFrame, or a function that gives one when it is needed.

    A query is rendered in the Spark dialect and handed to Catalyst, which plans it like any SQL; parameters are
    bound, never spliced in. Tables are temporary views with names of this engine alone, so several engines may have
    tables of one name in one session, and views of the session's own aren't touched. Trusted SQL that names a table
    finds its view by view(name). The views go when the engine does; DataFrames that it gave stay.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable] | None = None, warehouse: str | None = None):
        self.spark = spark
        self.warehouse = warehouse
        self._later: dict[str, Callable] = {}
        self.tables: dict[str, DataFrame] = _Tables(lambda name, later=self._later, me=weakref.ref(self): me().register(name, later.pop(name)()))
        self._prefix = f"quillon_{uuid.uuid4().hex[:12]}"
        self._views: dict[str, str] = {}
        self._names: set[str] = set()
        weakref.finalize(self, _drop_views, spark, self._names).atexit = False
        for name, df in (tables or {}).items():
            self.register(name, df)

    def register(self, name: str, df: DataFrame | Callable) -> DataFrame | None:
        """Give a table; one of the same name before it is replaced, for queries from now on."""
        if not isinstance(df, DataFrame) and callable(df):
            self.tables.pop(name, None)
            self._later[name] = df
            return None
        self._later.pop(name, None)
        self.tables[name] = df
        view = self._views.setdefault(name, f"{self._prefix}_{len(self._views)}")
        self._names.add(view)
        df.createOrReplaceTempView(view)
        return df

    def view(self, name: str) -> str:
        """The name of a table's view; one that isn't registered is looked for in the session's catalog."""
        if name in self._later:
            self.tables[name]
        return self._views.get(name, name)

    @property
    def adapter(self) -> Adapter:
        return Adapter(self.run, relations=self.view)

    def run(self, statement: Rendered) -> DataFrame:
        return self._sql(statement.text, statement.parameters)

    def _sql(self, text: str, parameters) -> DataFrame:
        """Parameters are named p1, p2 ...: positional ones aren't bound in the order of the text in every plan."""
        return self.spark.sql(text, args={f"p{i}": x for i, x in enumerate(parameters, 1)} or None)

    def dataframe(self, query: Query) -> DataFrame:
        """A query as a lazy DataFrame."""
        if query.kind in MUTATIONS:
            raise T.QueryError("a mutation is run by mutate()")
        return self.run(render(query, spark_dialect, self.view))

    # --- mutations ----------------------------------------------------------------------------------------------

    def mutate(self, query: Query) -> DataFrame | None:
        """Applies a mutation; gives the returned rows, if asked for.

        The new version is written beside the old one when the engine has a warehouse, else it stays lazy. Every
        assignment and returned value reads the rows as they were before (UPDATE returns new values). Columns with a
        generated expression are computed from the new values, and an ON UPDATE expression is assigned where the
        query assigns nothing.
        """
        if query.kind not in MUTATIONS or query.info[0] == "own":
            raise T.QueryError("the engine runs INSERT, UPDATE and DELETE as this library makes them")
        if query.kind == "insert":
            return self._insert(query)
        table, *rest = query.info
        by = rest[-1]
        name = table.definition.name
        ctx = Context(spark_dialect, relations=self.view)
        hit = f"COALESCE({by['where'].exprs[0].render(ctx)}, FALSE)" if "where" in by else "TRUE"
        old, source = self.tables[name], ctx.table(name)
        if query.kind == "delete":
            gone = self._sql(f"SELECT * FROM {source} WHERE {hit}", ctx.parameters)
            left = self._sql(f"SELECT * FROM {source} WHERE NOT {hit}", ctx.parameters)
            back = self._returned(query, table, gone)
            self._swap(name, left)
            return back
        own = {table.fields[k]: e for k, e in rest[0].items()}
        marks, fixed = fresh(old.columns, "_hit"), {table.fields[f]: c for f, c in table.definition.columns.items()}
        parts = []
        for c in old.columns:
            kind = old.schema[c].dataType.simpleString()
            text = own[c].render(ctx) if c in own else None
            if text is None and c in fixed and isinstance(fixed[c].on_update, Expr):
                text = render_schema_expression(fixed[c].on_update, spark_dialect)
            parts.append(f"CASE WHEN {hit} THEN CAST({text} AS {kind}) ELSE `{name}`.`{c}` END AS `{c}`" if text else f"`{name}`.`{c}`")
        new = self._sql(f"SELECT {', '.join(parts)}, {hit} AS `{marks}` FROM {source}", ctx.parameters)
        made = {c: fixed[c].generated_as for c in old.columns if c in fixed and fixed[c].generated_as is not None}
        if made:
            again = lambda c: f"CASE WHEN `{marks}` THEN CAST({render_schema_expression(made[c], spark_dialect)} AS {old.schema[c].dataType.simpleString()}) ELSE `{c}` END AS `{c}`"
            new = new.selectExpr(*(again(c) if c in made else f"`{c}`" for c in new.columns))
        new = self._written(name, new)
        back = self._returned(query, table, new.where(f"`{marks}`").drop(marks))
        self.register(name, new.drop(marks))
        return back

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        if self.warehouse is None:
            return df
        path = f"{self.warehouse}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _swap(self, name: str, df: DataFrame) -> None:
        self.register(name, self._written(name, df))

    def _returned(self, query: Query, table: Source, rows: DataFrame) -> DataFrame | None:
        by = query.info[-1]
        if "returning" not in by:
            return None
        view = f"{self._prefix}_returned"
        self._names.add(view)
        rows.createOrReplaceTempView(view)
        own = table.definition.name
        return self.run(render(select(by["returning"].info, from_(table)), spark_dialect, lambda name: view if name == own else self.view(name)))

    def _insert(self, query: Query) -> DataFrame | None:
        table, kind, own, columns, by = query.info
        d, name = table.definition, table.definition.name
        old = self.tables[name]
        rows = self._source_rows(table, kind, own, columns)
        numbered = any(c.identity and f not in columns for f, c in d.columns.items())
        if numbered:
            rows = self._numbered(name, rows)
        out, made = [], {}
        for f, c in d.columns.items():
            target, kind_ = table.fields[f], old.schema[table.fields[f]].dataType.simpleString()
            if f in columns:
                out.append(f"CAST(`{target}` AS {kind_}) AS `{target}`")
            elif c.identity:
                # Ids follow the largest one, in the order of the input rows.
                top = old.selectExpr(f"coalesce(max(`{target}`), 0)").first()[0]
                out.append(f"CAST({top} + `_quillon_row` AS {kind_}) AS `{target}`")
            elif c.generated_as is not None:
                made[target] = f"CAST({render_schema_expression(c.generated_as, spark_dialect)} AS {kind_}) AS `{target}`"
            elif isinstance(c.default, Default) and c.default.kind == "literal":
                v = c.default.value
                text = "NULL" if v is None else str(v).upper() if isinstance(v, bool) else Context(spark_dialect).literal(v) if isinstance(v, str) else repr(v)
                out.append(f"CAST({text} AS {kind_}) AS `{target}`")
            elif isinstance(c.default, Default) and c.default.kind == "expression":
                out.append(f"CAST({render_schema_expression(c.default.value, spark_dialect, "default")} AS {kind_}) AS `{target}`")
            else:
                out.append(f"CAST(NULL AS {kind_}) AS `{target}`")
        # Generated columns read the others' new values, defaults and identities included.
        new = rows.selectExpr(*out)
        new = self._written(f"{name}-rows", (new.selectExpr("*", *made.values()) if made else new).select(*old.columns))
        back = self._returned(query, table, new)
        self._swap(name, old.unionByName(new))
        return back

    def _numbered(self, name: str, rows: DataFrame) -> DataFrame:
        """``_quillon_row`` as 1, 2, 3 ... : the counts of the partitions, a row each, give where each one starts."""
        rows = self._written(f"{name}-input", rows)
        part = "shiftright(`_quillon_row`, 33)"
        counts = sorted(rows.groupBy(F.expr(part).alias("part")).count().collect())
        starts, total = [], 1
        for p, n in counts:
            starts.append((p, total))
            total += n
        at = F.broadcast(self.spark.createDataFrame(starts, "_quillon_part long, _quillon_start long"))
        return rows.join(at, F.expr(part) == F.col("_quillon_part")).withColumn("_quillon_row", F.expr("`_quillon_row` & 8589934591L") + F.col("_quillon_start")).drop("_quillon_part", "_quillon_start")

    def _source_rows(self, table, kind, own, columns) -> DataFrame:
        names = [table.fields[c] for c in columns]
        if kind == "select":
            df = self.dataframe(own[0])
            return df.toDF(*names).selectExpr("*", "monotonically_increasing_id() AS _quillon_row")
        if not columns:
            return self.spark.range(max(1, len(own))).selectExpr("id AS _quillon_row")
        ctx, parts = Context(spark_dialect), []
        for i, r in enumerate(own):
            texts = [f"{as_expr(r[c], table.definition.columns[c].domain).render(ctx)} AS `{table.fields[c]}`" for c in columns]
            parts.append(f"SELECT {', '.join(texts)}, CAST({i} AS BIGINT) AS _quillon_row")
        return self._sql(" UNION ALL ".join(parts), ctx.parameters)
