"""Text of expressions, clauses and JSON paths in each dialect, and what is refused; no session is needed."""

import pytest

import quillon as q

t = q.table("t", {"id": q.integer(), "label": q.text(nullable=True), "doc": q.json(nullable=True), "at": q.timestamp()}, lambda s: {"pk": q.primary_key(s.id)})
u = q.table("u", {"id": q.integer(), "tId": q.integer(), "size": q.numeric()})
DIALECTS = {d.name: d for d in (q.standard_dialect, q.postgres_dialect, q.sqlite_dialect, q.mysql_dialect, q.spark_dialect)}


def text(e, dialect="standard-sql", **more):
    out = q.render(q.select({"x": e, **more}, q.from_(t)), DIALECTS[dialect]).text
    quote = DIALECTS[dialect].quote
    return out.removeprefix("SELECT ").removesuffix(f" AS {quote}x{quote} FROM {quote}t{quote}")


@pytest.mark.parametrize("kind, wanted", [
    ("text", {
        "standard-sql": """JSON_VALUE("t"."doc", '$."a b"[2]' RETURNING VARCHAR NULL ON EMPTY NULL ON ERROR)""",
        "postgresql": """(jsonb_path_query_first(CAST("t"."doc" AS JSONB), '$."a b"[2] ? (@.type() == "string")') #>> '{}')""",
        "sqlite": """CASE WHEN json_type("t"."doc", '$."a b"[2]') IN ('text') THEN json_extract("t"."doc", '$."a b"[2]') END""",
        "mysql": """CASE WHEN JSON_TYPE(JSON_EXTRACT(`t`.`doc`, '$."a b"[2]')) IN ('STRING') THEN JSON_UNQUOTE(JSON_EXTRACT(`t`.`doc`, '$."a b"[2]')) END""",
    }),
    ("number", {"postgresql": """CAST(jsonb_path_query_first(CAST("t"."doc" AS JSONB), '$."a b"[2] ? (@.type() == "number")') #>> '{}' AS NUMERIC)"""}),
    ("boolean", {"sqlite": """CASE WHEN json_type("t"."doc", '$."a b"[2]') IN ('true', 'false') THEN json_extract("t"."doc", '$."a b"[2]') END"""}),
    ("exists", {
        "standard-sql": """JSON_EXISTS("t"."doc", '$."a b"[2]')""", "postgresql": """COALESCE(jsonb_path_exists(CAST("t"."doc" AS JSONB), '$."a b"[2]'), FALSE)""", "sqlite": """(json_type("t"."doc", '$."a b"[2]') IS NOT NULL)""",
        "mysql": """COALESCE(JSON_CONTAINS_PATH(`t`.`doc`, 'one', '$."a b"[2]'), FALSE)""",
    }),
])
def test_json_paths(kind, wanted):
    make = {"text": q.json_text, "number": q.json_number, "boolean": q.json_boolean, "exists": q.json_exists}[kind]
    for name, sql in wanted.items():
        assert text(make(t.doc, ["a b", 2]), name) == sql
    assert q.json_path("a", 0) == ("a", 0)
    for bad in ([-1], [True], [1.5]):
        with pytest.raises(q.QueryError):
            make(t.doc, bad)
    with pytest.raises(q.DomainError):
        make(t.id, ["a"])
    with pytest.raises(q.UnsupportedError):
        text(make(t.doc, ["a'b\"c"]), "spark")


def test_sqlite_json_semantics():
    import sqlite3

    c = sqlite3.connect(":memory:")
    c.execute("create table t (id integer, label text, doc text, at text)")
    rows = ['{"user":{"name":"Ada","active":true,"email":null},"scores":[9.5]}', '{"user":{"name":42,"active":"yes"},"scores":["high"]}', '{"user":null}', None]
    c.executemany("insert into t (id, doc) values (?, ?)", list(enumerate(rows)))
    s = q.render(q.select({"id": t.id, "name": q.json_text(t.doc, ["user", "name"]), "score": q.json_number(t.doc, ["scores", 0]), "active": q.json_boolean(t.doc, ["user", "active"]), "email": q.json_exists(t.doc, ["user", "email"])}, q.from_(t), q.order_by(t.id)), q.sqlite_dialect)
    assert c.execute(s.text, s.parameters).fetchall() == [(0, "Ada", 9.5, 1, 1), (1, None, None, None, 0), (2, None, None, None, 0), (3, None, None, None, 0)]


def test_calls_and_casts():
    assert text(q.typed_call("app.f", t.id, 3, domain=q.sum_(t.id).domain)) == 'app.f("t"."id", ?)' and q.routine_name("a.b") == "a.b"
    assert text(q.typed_value("x", t.label.domain)) == "?" and q.typed_value("x", t.label.domain).domain == t.label.domain
    assert text(q.cast(t.id, "NUMERIC(9, 2)")) == 'CAST("t"."id" AS NUMERIC(9, 2))' and q.typed_cast(t.id, "TEXT", t.label.domain).domain == t.label.domain
    for name, kind in (("postgresql", "BYTEA"), ("sqlite", "BLOB"), ("mysql", "BINARY"), ("spark", "BINARY")):
        assert f"AS {kind})" in text(q.cast(t.label, q.binary()), name)
    for bad in ("", "f(", "1f", "a..b"):
        with pytest.raises(q.QueryError):
            q.routine_name(bad)
    assert q.is_column_reference(t.id) and not q.is_column_reference(q.value(1)) and q.is_expression(t.id) and not q.is_expression(t)


def test_raw_parts():
    assert text(q.parenthesize(q.comma_separated([t.id, "1", q.identifier("a", "b")]))) == '("t"."id", 1, "a"."b")'
    assert text(q.sequence([t.id, "||", q.parameter("z")], " ")) == '"t"."id" || ?'
    own = q.make_expression(lambda ctx, a, b: f"F({a} USING {b})", t.id, t.label)
    assert text(own, "mysql") == "F(`t`.`id` USING `t`.`label`)" and not own.schema_safe
    total = q.make_expression(lambda ctx, a: f"MEDIAN({a})", t.id, aggregate=True)
    assert q.render(q.select({"m": total, "n": t.label}, q.from_(t), q.group_by(t.label))).text == 'SELECT MEDIAN("t"."id") AS "m", "t"."label" AS "n" FROM "t" GROUP BY "t"."label"'
    with pytest.raises(q.GroupingError):
        q.select({"m": total, "n": t.label}, q.from_(t))


def test_capabilities():
    e = q.with_dialect_capability(t.id, "ilike")
    q.assert_dialect_capability(q.postgres_dialect, "ilike")
    assert text(e, "postgresql") == '"t"."id"'
    d = q.alias(q.select({"x": e}, q.from_(t)), "d")
    for query in (q.select({"x": e}, q.from_(t)), q.select({"x": d.x}, q.from_(d)), q.union(q.select({"x": e}, q.from_(t)), q.select({"x": u.id}, q.from_(u))), q.select({"x": q.scalar(q.select({"x": e}, q.from_(t), q.limit(1)))})):
        with pytest.raises(q.CapabilityError):
            q.render(query, q.sqlite_dialect)
        q.render(query, q.postgres_dialect)
    with pytest.raises(q.CapabilityError):
        q.assert_dialect_capability(q.mysql_dialect, "ilike")


def test_joins_and_sets_by_name():
    on = q.eq(u.tId, t.id)
    for kind, word in (("inner", "INNER JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
        assert q.render(q.select({"x": t.id}, q.from_(t), q.join(kind, u, on))).text == f'SELECT "t"."id" AS "x" FROM "t" {word} "u" ON ("u"."t_id" = "t"."id")'
    for kind in ("cross", "natural"):
        assert f"{kind.upper()} JOIN" in q.render(q.select({"x": t.id}, q.from_(t), q.join(kind, u))).text
    with pytest.raises(q.QueryError):
        q.join("semi", u, on)
    a, b = q.select({"x": t.id, "y": t.label}, q.from_(t)), q.select({"y": t.label, "x": t.id}, q.from_(t))
    for op in ("UNION", "UNION ALL", "INTERSECT", "EXCEPT"):
        assert q.render(q.set_operation(op, a, b)).text == '(SELECT "t"."id" AS "x", "t"."label" AS "y" FROM "t") %s (SELECT "t"."id" AS "x", "t"."label" AS "y" FROM "t")' % op
    for bad in (lambda: q.set_operation("MINUS", a, b), lambda: q.union(a, q.select({"x": t.id}, q.from_(t))), lambda: q.union(a, q.select({"x": t.label, "y": t.id}, q.from_(t)))):
        with pytest.raises(q.QueryError):
            bad()


def test_pagination_and_order():
    s = q.select({"x": t.id}, q.from_(t), q.order_by(q.order(t.id, "desc", "last"), q.nulls_first(t.label)), q.fetch_next(3))
    assert q.render(s).text == 'SELECT "t"."id" AS "x" FROM "t" ORDER BY "t"."id" DESC NULLS LAST, "t"."label" NULLS FIRST FETCH FIRST ? ROWS ONLY'
    assert q.render(s, q.spark_dialect).text.endswith("LIMIT :p1")
    w = q.window([t.label], [q.desc(t.id)])
    assert text(q.over(q.rank(), w)) == 'RANK() OVER (PARTITION BY "t"."label" ORDER BY "t"."id" DESC)' and text(q.over(q.row_number()), "spark") == "ROW_NUMBER() OVER (ORDER BY 1)"


def test_domains_of_fields():
    assert q.require_fields(t, {"id": t.id.domain}) is t
    for bad in ({"none": t.id.domain}, {"label": t.id.domain}):
        with pytest.raises(q.QueryError):
            q.require_fields(t, bad)
    assert q.canonical_literal(-0.0) == 0.0 and str(q.canonical_literal(-0.0)) == "0.0" and q.canonical_literal("x") == "x"
    assert q.storage_of(q.native_column("mysql", "TINYINT")) == q.native_storage("mysql", "TINYINT") and q.storage_of(q.uuid()) == q.portable_storage(t.label.domain) | {"type": "uuid"}
    assert q.resolve_column_behavior(identity=True).identity == q.identity_column() and q.generated_table_name("userNames") == "user_names"
