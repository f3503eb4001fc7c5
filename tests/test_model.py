"""Construction-time checks, rendering in each dialect, NULL semantics, JSON, mutations and schema metadata."""

import datetime

import pytest

import quillon as q

users = q.table("users", {"id": q.integer(), "userName": q.text(), "email": q.text(nullable=True), "uid": q.uuid(), "doc": q.json(nullable=True)}, lambda s: {"pk": q.primary_key(s.id)})
posts = q.table("posts", {"id": q.integer(generated=True), "authorId": q.integer(), "title": q.text(), "views": q.integer(default=q.default_literal(0))})


def sql(query, dialect=q.standard_dialect):
    return q.render(query, dialect).text


def test_names():
    assert [q.snake_case(x) for x in ("userID", "APIKey", "a-b c", "createdAt")] == ["user_id", "api_key", "a_b_c", "created_at"]
    with pytest.raises(q.QueryError):
        q.sql_names({"userId": None, "userID": None})
    with pytest.raises(q.QueryError):
        q.sql_names({"x": " "})


def test_dialects():
    s = q.select({"n": users.userName}, q.limit(5), q.offset(2), q.from_(users), q.where(q.eq(users.id, 7)))
    assert q.render(s) == q.Rendered('SELECT "users"."user_name" AS "n" FROM "users" WHERE ("users"."id" = ?) OFFSET ? ROWS FETCH FIRST ? ROWS ONLY', (7, 2, 5))
    assert q.render(s, q.postgres_dialect).text.endswith('= $1) LIMIT $2 OFFSET $3') and q.render(s, q.postgres_dialect).parameters == (7, 5, 2)
    only = q.select({"n": users.id}, q.from_(users), q.offset(2))
    assert sql(only, q.sqlite_dialect).endswith("LIMIT -1 OFFSET ?") and sql(only, q.mysql_dialect).endswith("LIMIT 18446744073709551615 OFFSET ?") and sql(only, q.spark_dialect).endswith("LIMIT ALL OFFSET :p1")
    c = q.select({"c": q.cast(users.id, q.text())}, q.from_(users))
    assert "AS CHAR)" in sql(c, q.mysql_dialect) and "AS STRING)" in sql(c, q.spark_dialect)
    with pytest.raises(q.CapabilityError):
        sql(q.select({"n": users.id}, q.from_(users), q.where(q.ilike(users.userName, "a%"))))
    own = q.create_dialect(q.postgres_dialect, name="own", quote="`")
    assert sql(only, own).startswith("SELECT `users`.`id`")


def test_null_and_empty_lists():
    assert "IS NULL" in sql(q.select({"x": q.eq(users.email, None)}, q.from_(users)))
    assert "IS NOT NULL" in sql(q.select({"x": q.ne(users.email, None)}, q.from_(users)))
    for f in (lambda: q.lt(users.id, None), lambda: q.between(users.id, None, 3)):
        with pytest.raises(TypeError):
            f()
    assert "(1 = 0)" in sql(q.select({"x": q.in_list(users.id, [])}, q.from_(users)))
    assert "(1 = 1)" in sql(q.select({"x": q.not_in(users.id, [])}, q.from_(users)))


def test_domains():
    for f in (
        lambda: q.eq(users.uid, users.userName), lambda: q.lt(users.uid, users.uid), lambda: q.like(users.id, "a"), lambda: q.asc(users.doc), lambda: q.sum_(users.userName),
        lambda: q.and_(users.id, users.id), lambda: q.minimum(users.uid), lambda: q.add(1, users.id), lambda: q.eq(users.doc, users.doc),
    ):
        with pytest.raises(q.DomainError):
            f()
    q.eq(users.uid, "text is fine as a literal")


def test_scope_and_grouping():
    with pytest.raises(q.ScopeError):
        q.select({"x": posts.title}, q.from_(users))
    with pytest.raises(q.GroupingError):
        q.select({"x": posts.title, "n": q.count()}, q.from_(posts), q.group_by(posts.authorId))
    with pytest.raises(q.GroupingError):
        q.select({"x": posts.title}, q.from_(posts), q.having(q.gt(q.count(), 1)))
    with pytest.raises(q.GroupingError):
        q.group_by(q.count())
    q.select({"x": users.userName, "n": q.count()}, q.from_(users), q.group_by(users.id))  # the key determines it
    a = q.alias(users, "a")
    q.select({"x": a.userName, "n": q.count()}, q.from_(a), q.group_by(a.id))
    d = q.alias(q.select({"id": users.id, "name": users.userName}, q.from_(users)), "d")
    with pytest.raises(q.GroupingError):
        q.select({"x": d["name"], "n": q.count()}, q.from_(d), q.group_by(d.id))
    q.select({"x": q.upper(users.email), "n": q.count()}, q.from_(users), q.group_by(q.upper(users.email)))
    with pytest.raises(q.GroupingError):
        q.select({"t": q.over(q.sum_(posts.views)), "a": posts.authorId}, q.from_(posts), q.group_by(posts.authorId))


def test_clauses():
    for f in (
        lambda: q.select({}, q.from_(users)), lambda: q.select({"x": users.id}, q.from_(users), q.limit(1), q.fetch_next(2)), lambda: q.and_(), lambda: q.from_(),
        lambda: q.when(False, q.from_(users)), lambda: q.scalar(q.select({"a": users.id, "b": users.id}, q.from_(users))), lambda: q.call("drop table; --"),
    ):
        with pytest.raises(q.QueryError):
            f()
    for n in (-1, 1.5, True):
        with pytest.raises(ValueError):
            q.limit(n)
    some = q.select({"x": users.id, "y": q.omit}, q.from_(users), q.where(q.and_(q.omit, q.omit)), q.order_by(q.omit), q.when(False, q.limit(3)))
    assert sql(some) == 'SELECT "users"."id" AS "x" FROM "users"'
    assert q.select({"x": q.value(1)}).cardinality == "exactly-one"
    assert q.select({"x": users.id}, q.from_(users), q.limit(1)).cardinality == "zero-or-one"
    assert q.select({"x": users.id}, q.from_(users), q.when(True, q.limit(1))).cardinality == "many"


def test_naming_modes_and_ctes():
    inner = q.select({"userId": users.id}, q.from_(users))
    d = q.alias(inner, "d")
    assert sql(q.select({"userId": d.userId}, q.from_(d))) == 'SELECT "d"."user_id" AS "userId" FROM (SELECT "users"."id" AS "user_id" FROM "users") AS "d"'
    c = q.cte("c", inner)
    with pytest.raises(q.ScopeError):
        sql(q.select({"x": c.userId}, q.from_(c)))
    assert sql(q.select({"x": c.userId}, q.from_(c), q.with_cte(c))).startswith('WITH "c" AS (SELECT')
    with pytest.raises(q.ScopeError):
        sql(q.select({"x": posts.id}, q.correlate(users), q.from_(posts), q.where(q.eq(posts.authorId, users.id))))


def test_left_join_makes_nullable():
    s = q.select({"t": posts.title, "n": q.count(), "c": q.coalesce(posts.title, "x")}, q.from_(users), q.left_join(posts, q.eq(posts.authorId, users.id)), q.group_by(posts.title))
    assert s.row["t"][1] and not s.row["n"][1]


@pytest.fixture(scope="module")
def engine(spark):
    e = q.Engine(spark)
    e.register("users", spark.createDataFrame([(1, "Ada", None, "u1", '{"user":{"name":"Ada","active":true,"email":null},"scores":[9.5]}'), (2, "bob", "b@x", "u2", '{"user":{"name":42,"active":"yes"},"scores":["high"]}'), (3, "Cy", "", "u3", '{"user":null}'), (4, "D", None, "u4", "{bad"), (5, "E", None, "u5", None)], "id int, user_name string, email string, uid string, doc string"))
    e.register("posts", spark.createDataFrame([(1, 1, "a", 3), (2, 1, "b", 4), (3, 2, "a", None)], "id int, author_id int, title string, views int"))
    return e


def test_json_truth_table(engine):
    f = {"k": users.id, "name": q.json_text(users.doc, ["user", "name"]), "score": q.json_number(users.doc, ["scores", 0]), "active": q.json_boolean(users.doc, ["user", "active"]), "email": q.json_exists(users.doc, ["user", "email"])}
    got = {r.k: tuple(r)[1:] for r in engine.dataframe(q.select(f, q.from_(users))).collect()}
    assert got == {1: ("Ada", 9.5, True, True), 2: (None, None, None, False), 3: (None, None, None, False), 4: (None, None, None, False), 5: (None, None, None, False)}


def test_three_valued_in(engine):
    inner = q.select({"x": posts.views}, q.from_(posts))
    rows = engine.dataframe(q.select({"k": users.id, "hit": q.in_query(users.id, inner)}, q.from_(users))).collect()
    assert {r.k: r.hit for r in rows} == {1: None, 2: None, 3: True, 4: True, 5: None}
    kept = engine.dataframe(q.select({"k": users.id}, q.from_(users), q.where(q.is_null(q.in_query(users.id, inner))))).collect()
    assert sorted(r.k for r in kept) == [1, 2, 5]
    assert engine.dataframe(q.select({"k": users.id}, q.from_(users), q.where(q.not_(q.in_query(users.id, inner))))).count() == 0


def test_injection_stays_a_value(engine):
    s = q.select({"k": users.id}, q.from_(users), q.where(q.eq(users.userName, "x' OR '1'='1")))
    assert engine.dataframe(s).count() == 0


def test_mutations(engine, tmp_path, spark):
    e = q.Engine(spark, {"posts": engine.tables["posts"]}, warehouse=f"file://{tmp_path}")
    back = e.mutate(q.update(posts, {"views": q.add(posts.views, 1), "title": "z"}, q.where(q.gt(posts.views, 3)), q.returning({"id": posts.id, "v": posts.views})))
    assert [tuple(r) for r in back.collect()] == [(2, 5)]
    assert sorted(map(tuple, e.tables["posts"].collect()), key=str) == [(1, 1, "a", 3), (2, 1, "z", 5), (3, 2, "a", None)]
    e.mutate(q.delete_from(posts, q.where(q.lt(posts.views, 4))))  # NULL isn't matched
    assert sorted(r.id for r in e.tables["posts"].collect()) == [2, 3]
    for f in (
        lambda: q.update(posts, {"title": "x"}), lambda: q.delete_from(posts), lambda: q.update(posts, {"id": 1}, q.allow_all()), lambda: q.update(posts, {"title": q.omit}, q.allow_all()),
        lambda: q.insert_into(posts, q.values({"title": "x"})), lambda: q.insert_into(posts, q.values({"title": "x", "authorId": 1, "id": 3})), lambda: q.values({"a": 1}, {"b": 1}),
        lambda: q.insert_select(q.select({"a": users.id}, q.from_(users)), ["x", "y"]),
    ):
        with pytest.raises(q.QueryError):
            f()
    text = q.render(q.insert_into(posts, q.values({"title": "t", "authorId": 2}), q.returning({"id": posts.id})), q.postgres_dialect)
    assert text == q.Rendered('INSERT INTO "posts" ("title", "author_id") VALUES ($1, $2) RETURNING "posts"."id" AS "id"', ("t", 2))


def test_execute_takes_either_order():
    seen = []
    adapter = q.Adapter(lambda r: seen.append(r) or 5, q.sqlite_dialect)
    s = q.select({"x": q.value(datetime.date(2020, 1, 1))})
    assert q.execute(s, adapter) == q.execute(adapter, s) == 5 and seen[0].text == 'SELECT ? AS "x"'


def test_schema_metadata():
    with pytest.raises(q.SchemaError):
        q.primary_key(users.email)
    with pytest.raises(q.SchemaError) as e:
        q.schema([("a", users), ("a", users), ("b/c", posts)], namespace=" x")
    assert {d[0] for d in e.value.diagnostics} == {"duplicate-table-id", "duplicate-physical-name", "invalid-table-id", "invalid-namespace"}
    with pytest.raises(q.SchemaError):
        q.table("t", {"a": q.integer(identity=True, default=q.default_literal(1))})
    with pytest.raises(q.SchemaError):
        q.check(q.gt(q.count(), 1))
    t = q.table("t", {"a": q.integer(), "b": q.text(nullable=True)}, lambda s: {"c": q.check(q.gt(s.a, 0)), "u": q.index(s.a, unique=True), "f": q.foreign_key([s.a], q.references(users, "id"))})
    assert t.keys == (frozenset(["a"]),)
    one, two = q.create_snapshot(q.schema({"users": users, "t": t})), q.create_snapshot(q.schema({"t": t, "users": users}))
    text = q.encode_snapshot(one)
    assert text == q.encode_snapshot(two) and q.snapshot_digest(one) == q.snapshot_digest(text) and q.decode_snapshot(text) == one
    for change in ({"version": 3}, {"extra": 1}, {"tables": one["tables"][::-1]}):
        with pytest.raises(q.SchemaError):
            q.decode_snapshot(one | change)
    assert q.render_schema_expression(q.gt(t.a, 3)) == '("a" > 3)'
    assert q.snapshot_digest("") == "quillon-fnv64-cbf29ce484222325" and q.snapshot_digest("a") == "quillon-fnv64-af63dc4c8601ec8c"


def test_database_snapshots():
    t = q.table("t", {"id": q.integer(identity=True), "body": q.json(nullable=True), "at": q.timestamp(), "raw": q.binary()}, lambda s: {"pk": q.primary_key(s.id)})
    expected = {q.postgres_database: ("INTEGER", "JSONB", "TIMESTAMP", "BYTEA"), q.sqlite_database: ("INTEGER", "TEXT", "TEXT", "BLOB"), q.mysql_database: ("INT", "JSON", "DATETIME", "VARBINARY")}
    for db, names in expected.items():
        document = q.create_database_snapshot(q.schema({"t": t}), db)
        assert {c["id"]: c["storage"]["declaration"] for c in document["tables"][0]["columns"]} == dict(zip(("id", "body", "at", "raw"), names, strict=True))
        assert q.decode_snapshot(q.encode_snapshot(document)) == document

    def said(db, columns, metadata=None, name="t"):
        return sorted((c, p.split(".", 3)[-1]) for c, p, _ in q.diagnostics(q.schema({"t": q.table(name, columns, metadata)}), db))

    option = "unsupported-dialect-option"
    wide = {"a": q.integer(), "b": q.integer(nullable=True)}
    assert [len(said(db, wide, name="é" * 32)) for db in expected] == [1, 0, 0] and [len(said(db, wide, name="n" * 65)) for db in expected] == [1, 0, 1]
    twice = {"a": q.integer(), "c": q.integer(generated_as=q.add(q.table("t", {"a": q.integer()}).a, 1), virtual=True)}
    assert [said(db, twice) for db in expected] == [[(option, "columns.c.generated")], [], []]
    assert [said(db, {"a": q.integer(on_update=q.add(q.value(1), 1))}) for db in expected] == [[(option, "columns.a.onUpdate")]] * 2 + [[]]
    assert [said(db, {"a": q.native_column("sqlite", "INT")}) for db in expected] == [[(option, "columns.a.storage")], [], [(option, "columns.a.storage")]]
    assert [len(said(db, {"a": q.text(identity=True)})) for db in expected] == [0, 2, 2]
    keys = {
        "check": lambda s: {"c": q.check(q.gt(s.a, 0), deferrable=True)}, "nulls": lambda s: {"u": q.unique_constraint(s.b, nulls_distinct=False)},
        "late": lambda s: {"p": q.primary_key(s.a, initially="deferred")}, "partial": lambda s: {"i": q.index(s.a, where=q.gt(s.a, 0))},
        "include": lambda s: {"i": q.index(s.a, include=(s.b,))}, "order": lambda s: {"i": q.index(q.asc(s.a, "first"))},
        "match": lambda s: {"f": q.foreign_key([s.a], q.references(t, "id"), match="full")}, "default": lambda s: {"f": q.foreign_key([s.a], q.references(t, "id"), on_delete="set default")},
        "deferred": lambda s: {"f": q.foreign_key([s.a], q.references(t, "id"), deferrable=True)},
    }
    found = {k: [len(said(db, wide, m)) for db in expected] for k, m in keys.items()}
    assert found == {"check": [1, 1, 1], "nulls": [1, 1, 1], "late": [1, 1, 1], "partial": [0, 0, 1], "include": [0, 1, 1], "order": [0, 0, 1], "match": [0, 1, 1], "default": [0, 0, 1], "deferred": [0, 0, 1]}
    assert q.try_create_database_snapshot(q.schema({"t": q.table("t", wide, keys["check"])}), q.sqlite_database)[0] is None
    with pytest.raises(q.SchemaError):
        q.create_database_snapshot(q.schema({"t": q.table("t", wide, keys["nulls"])}), q.mysql_database)
    assert [q.affinity(d) for d in ("BIGINT", "VARCHAR(3)", "", "DOUBLE", "DECIMAL(3)")] == ["integer", "text", "blob", "real", "numeric"]


def test_streaming(engine, spark, tmp_path):
    from quillon.streaming import stream

    engine.tables["posts"].write.parquet(f"{tmp_path}/in")
    e = q.Engine(spark, {"posts": spark.readStream.schema(engine.tables["posts"].schema).parquet(f"{tmp_path}/in")})
    run = stream(e, q.select({"id": posts.id}, q.from_(posts), q.where(q.gt(posts.views, 3))), name="seen")
    run.processAllAvailable()
    run.stop()
    assert [r.id for r in spark.table("seen").collect()] == [2]
    engine.register("posts", engine.tables["posts"])


def test_correlation_over_levels():
    t, u, v, w = (q.table(n, {"a": q.integer()}) for n in "tuvw")

    def nested(middle, *joins):
        last = q.select({"x": w.a}, q.from_(w), q.correlate(v, t), q.where(q.and_(q.eq(w.a, v.a), q.eq(w.a, t.a))))
        between = q.select({"x": v.a}, q.from_(v), q.correlate(u, t), q.where(q.and_(q.eq(v.a, u.a), q.exists(last))))
        outside = q.select({"x": u.a}, q.correlate(t), middle, *joins, q.where(q.exists(between)))
        return q.select({"x": t.a}, q.from_(t), q.where(q.exists(outside)))

    text = sql(nested(q.from_(u)), q.spark_dialect)
    assert "(SELECT *, `t`.`a` AS `_outer0` FROM `u`) AS `u`" in text and "(SELECT *, `u`.`_outer0` AS `_outer0` FROM `v`) AS `v`" in text and "(`w`.`a` = `v`.`_outer0`)" in text
    assert '("w"."a" = "t"."a")' in sql(nested(q.from_(u)), q.postgres_dialect) and "_outer" not in sql(nested(q.from_(u)), q.postgres_dialect)
    other = q.alias(u, "other")
    with pytest.raises(q.UnsupportedError):
        sql(nested(q.from_(u), q.right_join(other, q.eq(u.a, other.a))), q.spark_dialect)


def test_schema_sql_of_one_dialect():
    raw = q.unsafe_schema_sql("postgresql", "x >\r\n0")
    assert q.is_unsafe_schema_sql(raw) and not q.is_unsafe_schema_sql(users.id) and q.normalize_schema_sql("a\r\n\rb") == "a\n\rb"
    now = q.default_expression(q.unsafe_schema_sql("postgresql", "now()"))
    t = q.table("t", {"x": q.integer(), "at": q.timestamp(default=now), "y": q.integer(generated_as=q.unsafe_schema_sql("postgresql", "x + 1"))}, lambda s: {"pk": q.primary_key(s.x), "ok": q.check(raw), "i": q.index(s.x, where=raw)})
    s = q.schema({"t": t})
    document = q.create_database_snapshot(s, q.postgres_database)
    held = document["tables"][0]
    assert held["constraints"]["ok"]["expression"] == held["indexes"]["i"]["where"] == {"dialect": "postgresql", "sql": "x >\n0"}
    at, _, y = held["columns"]
    assert at["default"]["sql"]["sql"] == "now()" and y["generatedAs"] == {"sql": {"dialect": "postgresql", "sql": "x + 1"}, "mode": "stored"}
    assert q.decode_snapshot(q.encode_snapshot(document)) == document
    assert q.render_schema_expression(raw, q.postgres_dialect) == "x >\n0"
    none, bad = q.try_create_database_snapshot(s, q.sqlite_database)
    assert none is None and sum("SQL of postgresql" in m for _, _, m in bad) == 4
    with pytest.raises(q.CapabilityError):
        q.render_schema_expression(raw, q.spark_dialect)
    with pytest.raises(q.QueryError):
        sql(q.select({"x": raw}, q.from_(users)))
    with pytest.raises(q.SchemaError):
        q.unsafe_schema_sql("postgresql", " ")


def test_snapshot_with_a_dangling_target_is_refused():
    users = q.table("users", {"id": q.integer()}, lambda s: {"pk": q.primary_key(s.id)})
    t = q.table("t", {"a": q.integer()}, lambda s: {"f": q.foreign_key([s.a], q.references(users, "id"))})
    assert q.decode_snapshot(q.create_snapshot(q.schema({"t": t, "users": users})))
    with pytest.raises(q.SchemaError, match="unknown-target"):
        q.decode_snapshot(q.create_snapshot(q.schema({"t": t})))
