"""Engines side by side, computed columns, numbered inserts, building blocks of one's own, snapshots."""

import datetime
import gc

import pytest

import quillon as q
from quillon.plans.catalog import engine, lineitem, nation, orders

SF = "/root/testdata/sf0."
users = q.table("users", {"id": q.integer(), "userName": q.text(), "email": q.text(nullable=True)}, lambda s: {"pk": q.primary_key(s.id)})


def lines(e):
    return e.dataframe(q.select({"n": q.count()}, q.from_(lineitem))).first().n


def test_two_engines_of_one_session_keep_their_tables(spark):
    one, two = engine(spark, SF + "001"), engine(spark, SF + "01")
    small, large = (spark.read.parquet(f"{SF}{x}/lineitem.parquet").count() for x in ("001", "01"))
    later = one.dataframe(q.select({"n": q.count()}, q.from_(lineitem)))
    assert (lines(one), lines(two), lines(one)) == (small, large, small)
    two.mutate(q.delete_from(nation, q.where(q.gt(nation.n_nationkey, 5))))
    back = one.mutate(q.update(nation, {"n_name": "X"}, q.where(q.eq(nation.n_nationkey, 3)), q.returning({"id": nation.n_nationkey})))
    assert [r.id for r in back.collect()] == [3]
    names = lambda e: {r.k: r.n for r in e.dataframe(q.select({"k": nation.n_nationkey, "n": nation.n_name}, q.from_(nation))).collect()}
    assert len(names(one)) == 25 and names(one)[3] == "X" and sorted(names(two)) == [0, 1, 2, 3, 4, 5] and names(two)[3] != "X"
    assert q.execute(q.select({"n": q.count()}, q.from_(lineitem)), two.adapter).first().n == large
    spark.range(3).createOrReplaceTempView("nation")
    assert len(names(one)) == 25 and spark.table("nation").count() == 3
    spark.catalog.dropTempView("nation")
    held = set(one._views.values()) & {t.name for t in spark.catalog.listTables()}
    assert held
    del one, back, names
    gc.collect()
    assert not held & {t.name for t in spark.catalog.listTables()} and later.first().n == small


def test_tables_are_read_when_they_are_needed(spark):
    seen = []

    def make():
        seen.append(1)
        return spark.range(3).selectExpr("cast(id as int) as id", "'n' as user_name", "cast(null as string) as email")

    e = q.Engine(spark, {"users": make})
    assert not seen
    assert e.dataframe(q.select({"x": users.id}, q.from_(users))).count() == 3 and e.tables["users"].count() == 3 and seen == [1]
    with pytest.raises(KeyError):
        e.tables["none"]


def test_generated_columns_follow_updates(spark, tmp_path):
    own = q.table("t", {"a": q.integer(), "v": q.integer()})
    t = q.table("t", {"a": q.integer(), "b": q.integer(generated_as=q.generated_column(q.add(own.a, 1))), "v": q.integer(default=q.default_literal(0), on_update=q.add(own.v, 1))})
    e = q.Engine(spark, {"t": spark.createDataFrame([(1, 2, 0), (5, 6, 0)], "a int, b int, v int")}, warehouse=f"file://{tmp_path}")
    back = e.mutate(q.update(t, {"a": 10}, q.where(q.eq(t.a, 1)), q.returning({"b": t.b, "v": t.v})))
    assert [tuple(r) for r in back.collect()] == [(11, 1)]
    e.mutate(q.insert_into(t, q.values({"a": 7})))
    assert sorted(map(tuple, e.tables["t"].collect())) == [(5, 6, 0), (7, 8, 0), (10, 11, 1)]


def test_inserts_are_numbered_without_gaps(spark):
    t = q.table("t", {"id": q.bigint(identity=q.identity_column()), "x": q.bigint(), "twice": q.bigint(generated_as=q.multiply(q.table("t", {"id": q.bigint()}).id, 2))})
    src = q.table("src", {"x": q.bigint()})
    e = q.Engine(spark, {"t": spark.createDataFrame([(4, 1, 8)], "id long, x long, twice long"), "src": spark.range(0, 1000, 1, 7).selectExpr("id as x")})
    e.mutate(q.insert_into(t, q.insert_select(q.select({"x": src.x}, q.from_(src), q.where(q.ne(q.modulo(src.x, 3), 0))), ["x"])))
    rows = sorted(map(tuple, e.tables["t"].collect()))
    assert [r[0] for r in rows] == list(range(4, 671)) and all(r[2] == 2 * r[0] for r in rows) and [r[1] for r in rows[1:]] == [x for x in range(1000) if x % 3]


def test_parameters_are_encoded_for_a_driver():
    seen = []
    encoder = q.DriverValueEncoder({datetime.date: str, bool: int})
    adapter = q.Adapter(seen.append, q.sqlite_dialect, encoder)
    q.execute(q.select({"a": q.value(datetime.date(2020, 1, 2)), "b": q.value(True), "c": q.value("x")}), adapter)
    assert seen[0].parameters == ("2020-01-02", 1, "x")


def test_names_by_characters():
    names = {"userID": "user_id", "APIKey": "api_key", "a-b  c": "a_b_c", "createdAt": "created_at", "x2Y": "x2_y", "ABC": "abc", "HTTPServer2": "http_server2", "éA": "éa", "a_B": "a_b", "A1B": "a1_b", "aBCd": "a_b_cd"}
    assert {k: q.snake_case(k) for k in names} == names


def test_fragments():
    f = q.fragment(lambda ctx: f"{ctx.quote('a')} + {ctx.parameter(3)}")
    s = q.render(q.select({"x": f, "y": q.sequence([q.keyword("current_date")]) if False else q.qualified_identifier("s", "t")}))
    assert s == q.Rendered('SELECT "a" + ? AS "x", "s"."t" AS "y"', (3,))
    assert q.is_fragment(f) and not q.is_fragment(3) and q.expression_fragment(f) is f and q.render(q.select({"x": q.syntax("1")})).text == 'SELECT 1 AS "x"'
    assert q.is_value_expression(q.as_value(3)) and q.as_value(f) is f and q.is_null_operand(q.value(None)) and not q.is_null_operand(q.value(0))
    with pytest.raises(q.QueryError):
        q.keyword("x; drop")
    safe = q.schema_call("ABS", users.id)
    assert q.is_schema_expression(safe) and not q.is_schema_expression(q.call("ABS", users.id)) and q.render_schema_expression(safe) == 'ABS("id")'
    own = q.make_schema_expression(lambda ctx, a: f"F({a})", users.id, domain=q.TEXT if hasattr(q, "TEXT") else users.userName.domain)
    assert q.render_schema_expression(own) == 'F("id")'
    assert [q.expression_category(x) for x in (q.count(), q.over(q.count()), q.value(1))] == ["aggregate", "window", "scalar"]
    with pytest.raises(q.QueryError):
        q.mark_schema_expression(q.count())


def test_clauses_sources_and_queries_of_ones_own(spark):
    e = q.Engine(spark, {"users": spark.range(10).selectExpr("cast(id as int) as id", "concat('u', id) as user_name", "cast(null as string) as email")})
    twice = q.create_clause("lateral-view", 45, lambda ctx: f"LATERAL VIEW EXPLODE(ARRAY({ctx.parameter(1)}, {ctx.parameter(2)})) v AS k")
    assert e.dataframe(q.select({"x": users.id}, q.from_(users), twice, q.where(q.lt(users.id, 8)))).count() == 16
    with pytest.raises(q.QueryError):
        q.select({"x": users.id}, q.from_(users), twice, twice)
    with pytest.raises(q.QueryError):
        q.create_clause("where", 50, lambda ctx: "")
    numbers = q.create_source("numbers", "n", {"id": q.bigint(), "label": q.text()}, lambda ctx: f"(SELECT id, concat('n', id) AS label FROM RANGE({ctx.parameter(5)})) AS {ctx.quote('n')}", keys=[["id"]])
    got = e.dataframe(q.select({"l": numbers.label, "c": q.count()}, q.from_(numbers), q.inner_join(users, q.eq(users.id, numbers.id)), q.group_by(numbers.id))).collect()
    assert sorted(map(tuple, got)) == [(f"n{i}", 1) for i in range(5)]
    raw = q.create_query("raw", {"x": (users.id.domain, False)}, lambda ctx: f"SELECT id AS x FROM {ctx.table('users')} WHERE id > {ctx.parameter(6)}", cardinality="many")
    assert sorted(r.x for r in e.dataframe(raw).collect()) == [7, 8, 9]
    d = q.alias(raw, "d")
    assert e.dataframe(q.select({"n": q.count()}, q.from_(d))).first().n == 3
    merge = q.create_mutation("merge", users, lambda ctx: f"MERGE INTO {ctx.quote('users')}", q.returning({"id": users.id}))
    assert q.has_returning_clause(merge) and q.render(merge).text == 'MERGE INTO "users"' and not q.has_returning_clause(q.delete_from(users, q.allow_all()))
    with pytest.raises(q.QueryError):
        e.mutate(merge)
    assert q.source_identity(users) == q.source_identity(users) != q.source_identity(q.alias(users, "users"))
    t = q.table("t", {"name": q.text(), "id": q.integer()})
    own = q.expose_columns(t)
    assert own["name"].key == q.expose_columns(t, ["name"])["name"].key and own.id.key == t.id.key and list(own) == ["name", "id"]
    with pytest.raises(AttributeError):
        own.name


def test_one_window_for_several_functions(spark):
    e = engine(spark, SF + "001")
    w = q.window([orders.o_custkey], [orders.o_orderkey])
    got = e.dataframe(q.select({"k": orders.o_orderkey, "a": q.over(q.row_number(), w), "b": q.over(q.count(), w), "c": q.over(q.count_distinct(orders.o_orderstatus), q.window([orders.o_custkey]))}, q.from_(orders))).collect()
    rows = spark.read.parquet(SF + "001/orders.parquet").collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.o_custkey, set()).add(r.o_orderstatus)
    of = {r.o_orderkey: r.o_custkey for r in rows}
    assert len(got) == len(rows) and all(r.a == r.b and r.c == len(kinds[of[r.k]]) for r in got)


def test_column_behaviors():
    t = q.table("t", {"a": q.integer()})
    for bad, code in (
        ({"default": q.default_literal(1), "has_default": False}, "default-flag-conflict"), ({"default": q.default_literal(1), "generated": True}, "default-generated-conflict"),
        ({"generated_as": q.add(t.a, 1), "generated": False}, "generated-flag-conflict"), ({"generated_as": q.add(t.a, 1), "identity": True}, "identity-generated-conflict"),
        ({"generated_as": q.add(t.a, 1), "has_default": True}, "default-generated-conflict"), ({"identity": True, "has_default": True}, "identity-generated-conflict"),
        ({"identity": q.identity_column("by-default"), "generated": False}, "generated-flag-conflict"), ({"on_update": q.call("NOW")}, "invalid-on-update"),
    ):
        with pytest.raises(q.BehaviorError) as e:
            q.resolve_column_behavior("c", **bad)
        assert code in [d[0] for d in e.value.diagnostics]
    c = q.resolve_column_behavior(has_default=True)
    assert c.default == q.external_default() and c.has_default and not c.generated
    c = q.resolve_column_behavior(generated_as=q.external_generated_column("virtual"))
    assert c.generated and c.virtual and c.generated_as is None
    for f in (lambda: q.generated_column(q.add(t.a, 1), "x"), lambda: q.identity_column("x"), lambda: q.default_literal(float("nan")), lambda: q.native_storage("", "x")):
        with pytest.raises(q.QueryError):
            f()


def _schema():
    t = q.table(
        "t", {"id": q.integer(identity=q.identity_column("by-default")), "a": q.integer(default=q.default_literal(2**60)), "b": q.integer(generated_as=q.add(q.table("t", {"a": q.integer()}).a, 1)), "n": q.native_column("sqlite", "INT")},
        lambda s: {"pk": q.primary_key(s.id), "ownKey": q.unique(s.a, s.b), "late": q.foreign_key([s.a], q.references(users, "id"), deferrable=True), "ok": q.check(q.gt(s.a, 0)), "byA": q.index(q.desc(s.a, "last"), unique=True, where=q.gt(s.a, 3), include=(s.b,))},
    )
    return q.schema({"t": t, "users": users})


def test_snapshots_are_decoded_strictly():
    one = q.create_snapshot(_schema())
    assert q.try_create_snapshot(_schema()) == (one, []) and q.decode_snapshot(q.encode_snapshot(one)) == one and q.canonicalize_snapshot(one) == q.encode_snapshot(one)
    table = one["tables"][0]
    assert [c["name"] for c in table["constraints"].values()] == ["late", "ok", "own_key", "pk"] and table["indexes"]["byA"]["name"] == "by_a"
    assert table["columns"][0]["default"]["value"] == {"~integer": str(2**60)} and table["columns"][2]["identity"] == {"mode": "by-default", "dialect": None}
    import copy

    def changed(path, value):
        d = copy.deepcopy(one)
        at = d
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        return d

    table, column = ("tables", 0), ("tables", 0, "columns", 0)
    for path, value, code in (
        ((*column, "nullable"), "yes", "invalid-value"), ((*column, "storage", "type"), "number", "invalid-value"), ((*column, "storage", "extra"), 1, "unknown-field"), ((*column, "storage", "kind"), "x", "invalid-value"),
        ((*column, "default"), {"kind": "literal"}, "missing-field"), ((*column, "default"), None, "default-flag-conflict"), ((*column, "generated"), True, "generated-flag-conflict"), ((*column, "name"), "b", "duplicate-name"),
        ((*table, "constraints", "pk", "columns"), ["none"], "unknown-column"), ((*table, "constraints", "pk", "deferrable"), "no", "invalid-value"), ((*table, "constraints", "late", "targetColumns"), ["id", "user_name"], "foreign-key-arity"),
        ((*table, "constraints", "late", "target"), "none", "unknown-target"), ((*table, "constraints", "late", "match"), "some", "invalid-value"), ((*table, "constraints", "pk", "name"), "ok", "duplicate-name"), ((*table, "indexes", "byA", "terms"), [], "invalid-value"),
        ((*table, "indexes", "byA", "include"), ["zz"], "unknown-column"), ((*table, "indexes", "byA", "terms", 0, "direction"), "up", "invalid-value"), (("version",), 99, "unsupported-version"), (("tables", 0, "id"), "z", "unsorted-ids"), (("tables",), {}, "invalid-value"),
        ((*table, "constraints", "ownKey", "columns"), ["a", "a"], "duplicate-column"), ((*table, "columns", 2, "nullable"), True, "nullable-key"),
    ):
        with pytest.raises(q.SnapshotError) as e:
            q.decode_snapshot(changed(path, value))
        assert code in [d[0] for d in e.value.diagnostics], (path, e.value)
    with pytest.raises(q.SnapshotError):
        q.decode_snapshot("{")
    dangling = q.schema({"t": _schema().tables["t"]})
    assert [d[0] for d in q.try_create_snapshot(dangling)[1]] == ["unknown-target"]
    with pytest.raises(q.RegistryError):
        q.schema({"t": q.table("t", {"a": q.integer()}, lambda s: {"oneKey": q.unique(s.a), "one_key": q.index(s.a)})})


def test_canonical_json():
    assert q.canonical_json({"b": [1.0, -0.5, float("inf"), 2**53], "a": None}) == '{"a":null,"b":[1,-0.5,{"~float":"inf"},{"~integer":"9007199254740992"}]}'
    assert q.canonical_json({"d": datetime.date(2020, 1, 2)}, {datetime.date: str}) == '{"d":"2020-01-02"}'
    held = []
    held.append({"x": held})
    for v, path in (({"a": [object()]}, "$.a[0]"), (held, "$[0].x"), ({1: 2}, "$")):
        with pytest.raises(q.CanonicalError) as e:
            q.canonical_json(v)
        assert e.value.path == path


def test_spark_snapshots_and_dialects_of_ones_own(spark):
    from quillon.schema.databases import create_schema_dialect, spark_types

    t = q.table("t", {"id": q.bigint(identity=True), "userName": q.text(nullable=True), "price": q.numeric(), "at": q.timestamp(), "raw": q.binary(), "tags": q.native_column("spark", "ARRAY<STRING>")}, lambda s: {"pk": q.primary_key(s.id)})
    document = q.create_database_snapshot(q.schema({"t": t}), q.spark_database)
    assert q.decode_snapshot(document) == document
    kinds = {f.name: (f.dataType.simpleString(), f.nullable) for f in spark_types(document)["t"]}
    assert kinds == {"id": ("bigint", False), "user_name": ("string", True), "price": ("double", False), "at": ("timestamp_ntz", False), "raw": ("binary", False), "tags": ("array<string>", False)}
    assert spark.createDataFrame([], spark_types(document)["t"]).columns == ["at", "id", "price", "raw", "tags", "user_name"]
    with pytest.raises(q.SchemaError):
        spark_types(q.create_snapshot(q.schema({"t": t})))
    late = q.unique(t.id, deferrable=True)
    assert q.validate_constraint(late, q.postgres_database) == [] and len(q.validate_constraint(late, q.sqlite_database, "$.x")) == 1
    part = q.index(t.id, where=q.gt(t.id, 3))
    assert q.validate_index(part, q.sqlite_database) == [] and [d[1] for d in q.validate_index(part, q.mysql_database, "$.i")] == ["$.i"]
    with pytest.raises(ValueError):
        q.validate_index(late, q.sqlite_database)
    own = create_schema_dialect(q.create_dialect(q.postgres_dialect, name="own"), q.postgres_database, lambda s, db: [("own", "$", db.name)], name_limit=1)
    found = own.diagnostics(q.schema({"t": q.table("tt", {"a": q.integer()})}))
    assert {d[0] for d in found} == {"own", "name-too-long"} and own.render(q.gt(t.id, 3)) == '("id" > 3)'
