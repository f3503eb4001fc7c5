"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from .. import functions  # noqa: F401
from ..functions.comparison import and_, between, eq, gt, gte, in_list, is_distinct_from, is_not_distinct_from, is_not_null, is_null, is_true, like, lt, lte, ne, not_, not_in, not_like, or_
from ..functions.scalar import add, average, call, case_when, cast, coalesce, concat, count, count_distinct, dense_rank, divide, json_boolean, json_exists, json_number, json_text, lower, maximum, minimum, modulo, multiply, over, rank, row_number, subtract, sum_, typed_cast, unsafe_expression, upper
from ..nodes import value
from ..operators.clauses import asc, correlate, cross_join, custom_clause, desc, distinct, from_, full_join, group_by, having, inner_join, left_join, limit, natural_join, nulls_first, nulls_last, offset, order_by, right_join, where, with_cte
from ..operators.mutation import allow_all, default_values, delete_from, insert_into, insert_select, returning, update, values
from ..operators.select import except_, exists, in_query, intersect, not_exists, scalar, select, union, union_all
from ..schema import default_literal, foreign_key, primary_key, references
from ..sources import alias, all_, bigint, cte, custom_source, integer, json, lateral, numeric, table, text, timestamp
from .engine import Engine
from .. import types as T

region = table("region", {"r_regionkey": integer(), "r_name": text()}, lambda s: {"pk": primary_key(s.r_regionkey)})
nation = table("nation", {"n_nationkey": integer(), "n_name": text(), "n_regionkey": integer()}, lambda s: {"pk": primary_key(s.n_nationkey), "region": foreign_key([s.n_regionkey], references(region, "r_regionkey"))})
customer = table("customer", {"c_custkey": bigint(), "c_name": text(), "c_nationkey": integer(), "c_acctbal": numeric(), "c_mktsegment": text()}, lambda s: {"pk": primary_key(s.c_custkey)})
supplier = table("supplier", {"s_suppkey": bigint(), "s_name": text(), "s_nationkey": integer(), "s_acctbal": numeric()}, lambda s: {"pk": primary_key(s.s_suppkey)})
part = table("part", {"p_partkey": bigint(), "p_name": text(), "p_brand": text(), "p_type": text(), "p_size": integer(), "p_retailprice": numeric()}, lambda s: {"pk": primary_key(s.p_partkey)})
orders = table("orders", {"o_orderkey": bigint(), "o_custkey": bigint(), "o_orderstatus": text(), "o_totalprice": numeric(), "o_orderdate": timestamp(), "o_orderpriority": text()}, lambda s: {"pk": primary_key(s.o_orderkey)})
lineitem = table("lineitem", {"l_orderkey": bigint(), "l_partkey": bigint(), "l_suppkey": bigint(), "l_linenumber": integer(), "l_quantity": numeric(), "l_extendedprice": numeric(), "l_discount": numeric(), "l_tax": numeric(), "l_returnflag": text(), "l_linestatus": text(), "l_shipdate": timestamp()})
events = table("events", {"event_id": bigint(), "ts": timestamp(), "user_id": bigint(), "event_type": text(), "value": numeric(), "props": json()}, lambda s: {"pk": primary_key(s.event_id)})
TABLES = [region, nation, customer, supplier, part, orders, lineitem, events]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the tables of ``sf_dir``; nothing is read until a query runs."""
    return Engine(spark, {t.name: lambda name=t.name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for t in TABLES})


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).dataframe(build())
    if sql:
        ORACLES[name] = sql


def _round(e, digits=2):
    return call("ROUND", e, unsafe_expression(str(digits)), domain=T.DECIMAL)


def _big(e):
    return typed_cast(e, "BIGINT", T.BIGINT)


c, o, n, s, r, line, p, ev = customer, orders, nation, supplier, region, lineitem, part, events
_D1, _D2 = datetime.datetime(1996, 1, 1), datetime.datetime(1998, 12, 31)


def _flagship():
    revenue = sum_(multiply(line.l_extendedprice, subtract(value(1), line.l_discount)))
    return select(
        {"nation_name": n.n_name, "revenue": _round(revenue), "order_count": count_distinct(o.o_orderkey)},
        from_(c), inner_join(o, eq(c.c_custkey, o.o_custkey)), inner_join(line, eq(line.l_orderkey, o.o_orderkey)), inner_join(n, eq(c.c_nationkey, n.n_nationkey)),
        where(between(o.o_orderdate, _D1, _D2)), group_by(n.n_name), having(gt(count(), 0)), order_by(desc(revenue)), limit(10),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).dataframe(_flagship())


_add("q_flagship", _flagship, """SELECT n_name AS nation_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS order_count
 FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
 WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY n_name ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC LIMIT 10""")
_add("q_filter_project", lambda: select(
    {"orderKey": line.l_orderkey, "qty": line.l_quantity, "flag": line.l_returnflag}, from_(line),
    where(and_(lt(line.l_quantity, 20), gte(line.l_discount, 0.03), or_(eq(line.l_returnflag, "R"), ne(line.l_linestatus, "O")), in_list(line.l_linenumber, [1, 2, 3]), not_in(line.l_linenumber, [2]), not_like(line.l_returnflag, "A%"), like(concat(line.l_returnflag, "/", line.l_linestatus), "%/_"), not_like(concat(line.l_returnflag, line.l_linestatus), "_F"), lte(line.l_tax, 0.07), not_(gt(line.l_extendedprice, 50000)), between(line.l_extendedprice, 1000, 45000))),
), """SELECT l_orderkey AS "orderKey", l_quantity AS qty, l_returnflag AS flag FROM lineitem WHERE l_quantity < 20 AND l_discount >= 0.03 AND (l_returnflag = 'R' OR l_linestatus <> 'O')
 AND l_linenumber IN (1, 2, 3) AND l_linenumber NOT IN (2) AND l_returnflag NOT LIKE 'A%' AND l_returnflag || '/' || l_linestatus LIKE '%/_' AND l_returnflag || l_linestatus NOT LIKE '_F'
 AND l_tax <= 0.07 AND NOT l_extendedprice > 50000 AND l_extendedprice BETWEEN 1000 AND 45000""")
_add("q_empty_in", lambda: select({"k": r.r_regionkey}, from_(r), where(in_list(r.r_regionkey, []))), "SELECT r_regionkey AS k FROM region WHERE FALSE")
_add("q_empty_not_in", lambda: select({"k": r.r_regionkey}, from_(r), where(not_in(r.r_regionkey, []))), "SELECT r_regionkey AS k FROM region")
_add("q_null_predicates", lambda: select(
    {"name": n.n_name, "missing": is_null(s.s_suppkey), "there": is_not_null(s.s_suppkey), "true_": is_true(gt(s.s_acctbal, 0)), "diff": is_distinct_from(s.s_suppkey, n.n_nationkey), "same": is_not_distinct_from(s.s_suppkey, n.n_nationkey), "by_eq": eq(s.s_name, None)},
    from_(n), left_join(s, and_(eq(s.s_nationkey, n.n_nationkey), gt(s.s_acctbal, 7000))),
), """SELECT n_name AS name, s_suppkey IS NULL AS missing, s_suppkey IS NOT NULL AS there, coalesce(s_acctbal > 0, FALSE) AS true_, s_suppkey IS DISTINCT FROM n_nationkey AS diff,
 s_suppkey IS NOT DISTINCT FROM n_nationkey AS same, s_name IS NULL AS by_eq FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 7000""")
for _kind, _join, _word in (("inner", inner_join, "JOIN"), ("left", left_join, "LEFT JOIN"), ("right", right_join, "RIGHT JOIN"), ("full", full_join, "FULL JOIN")):
    _add(f"q_{_kind}_join", lambda j=_join: select({"nation": n.n_name, "supplier": s.s_name}, from_(n), j(s, and_(eq(s.s_nationkey, n.n_nationkey), gt(s.s_acctbal, 3000), ne(n.n_regionkey, 3)))),
         f"SELECT n_name AS nation, s_name AS supplier FROM nation {_word} supplier ON s_nationkey = n_nationkey AND s_acctbal > 3000 AND n_regionkey <> 3")
_add("q_cross_join", lambda: select({"a": r.r_name, "b": n.n_name}, from_(r), cross_join(n)), "SELECT r_name AS a, n_name AS b FROM region CROSS JOIN nation")
_add("q_natural_join", lambda: (lambda a, b: select({"k": a.key, "x": a.x, "y": b.y}, from_(a), natural_join(b)))(alias(select({"key": n.n_nationkey, "x": n.n_name}, from_(n)), "a"), alias(select({"key": r.r_regionkey, "y": r.r_name}, from_(r)), "b")),
     "SELECT n_nationkey AS k, n_name AS x, r_name AS y FROM nation JOIN region ON n_nationkey = r_regionkey")
_add("q_self_join_alias", lambda: (lambda a, b: select({"a": a.n_name, "b": b.n_name}, from_(a), inner_join(b, and_(eq(a.n_regionkey, b.n_regionkey), lt(a.n_nationkey, b.n_nationkey)))))(alias(n, "a"), alias(n, "b")),
     "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("q_comma_from", lambda: select({"region": r.r_name, "nation": n.n_name}, from_(r, n), where(eq(r.r_regionkey, n.n_regionkey))), "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE r_regionkey = n_regionkey")
_add("q_all_columns", lambda: select(all_(n), from_(n)), "SELECT * FROM nation")
_add("q_group_having", lambda: select(
    {"flag": line.l_returnflag, "status": line.l_linestatus, "n": count(), "parts": count_distinct(line.l_partkey), "qty": _round(sum_(line.l_quantity)), "price": _round(average(line.l_extendedprice)), "low": minimum(line.l_discount), "high": maximum(line.l_tax), "some": count(line.l_suppkey)},
    from_(line), group_by(line.l_returnflag, line.l_linestatus), having(gt(count(), 10)), order_by(desc(count())),
), """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price,
 min(l_discount) AS low, max(l_tax) AS high, count(l_suppkey) AS some FROM lineitem GROUP BY ALL HAVING count(*) > 10""")
_last = lambda: call("SUBSTR", lower(c.c_mktsegment), unsafe_expression("1"), unsafe_expression("2"))
_add("q_group_expr", lambda: select({"start": _last(), "nation": modulo(c.c_nationkey, 7), "n": count(), "rich": maximum(c.c_acctbal)}, from_(c), group_by(_last(), modulo(c.c_nationkey, 7))),
     "SELECT substr(lower(c_mktsegment), 1, 2) AS start, c_nationkey % 7 AS nation, count(*) AS n, max(c_acctbal) AS rich FROM customer GROUP BY 1, 2")
_add("q_group_fd", lambda: select({"id": c.c_custkey, "name": c.c_name, "segment": c.c_mktsegment, "n": count(o.o_orderkey)}, from_(c), left_join(o, eq(o.o_custkey, c.c_custkey)), group_by(c.c_custkey)),
     "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment")
_add("q_global_agg", lambda: select({"n": count(), "top": maximum(o.o_totalprice)}, from_(o), having(gt(count(), 0))), "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")
_add("q_distinct", lambda: select({"status": o.o_orderstatus, "priority": o.o_orderpriority}, from_(o), distinct()), "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
_add("q_order_nulls", lambda: select({"nation": n.n_nationkey, "supplier": s.s_suppkey}, from_(n), left_join(s, and_(eq(s.s_nationkey, n.n_nationkey), gt(s.s_acctbal, 6000))), order_by(nulls_first(s.s_suppkey), asc(n.n_nationkey))),
     "SELECT n_nationkey AS nation, s_suppkey AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 6000 ORDER BY s_suppkey ASC NULLS FIRST, n_nationkey")
_add("q_order_nulls_last", lambda: select({"nation": n.n_nationkey, "supplier": s.s_suppkey}, from_(n), left_join(s, and_(eq(s.s_nationkey, n.n_nationkey), gt(s.s_acctbal, 6000))), order_by(nulls_last(s.s_suppkey), desc(n.n_nationkey))),
     "SELECT n_nationkey AS nation, s_suppkey AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 6000 ORDER BY s_suppkey ASC NULLS LAST, n_nationkey DESC")
_add("q_offset_limit", lambda: select({"k": o.o_orderkey, "price": o.o_totalprice}, from_(o), order_by(desc(o.o_totalprice), asc(o.o_orderkey)), offset(20), limit(15)), "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 20")
_add("q_offset_only", lambda: select({"k": n.n_nationkey}, from_(n), order_by(asc(n.n_nationkey)), offset(20)), "SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey OFFSET 20")
_W = {"partition_by": [o.o_custkey], "order_by": [desc(o.o_orderdate), asc(o.o_orderkey)]}
_add("q_window_row_number", lambda: select({"k": o.o_orderkey, "rn": _big(over(row_number(), **_W))}, from_(o)), "SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders")
_add("q_window_rank", lambda: select({"k": o.o_orderkey, "rk": _big(over(rank(), partition_by=[o.o_custkey], order_by=[o.o_orderpriority])), "dr": _big(over(dense_rank(), partition_by=[o.o_custkey], order_by=[o.o_orderpriority])), "one": _big(over(rank(), partition_by=[o.o_custkey]))}, from_(o)),
     "SELECT o_orderkey AS k, rank() OVER w AS rk, dense_rank() OVER w AS dr, CAST(1 AS BIGINT) AS one FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
_add("q_window_agg", lambda: select({"k": o.o_orderkey, "total": _round(over(sum_(o.o_totalprice), partition_by=[o.o_custkey])), "running": over(count(), **_W), "kinds": over(count_distinct(o.o_orderstatus), partition_by=[o.o_custkey])}, from_(o)),
     """SELECT o_orderkey AS k, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS running,
 count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS kinds FROM orders""")
_add("q_window_over_agg", lambda: select({"status": o.o_orderstatus, "n": count(), "rk": _big(over(rank(), order_by=[desc(count()), asc(o.o_orderstatus)]))}, from_(o), group_by(o.o_orderstatus)),
     "SELECT o_orderstatus AS status, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_orderstatus) AS rk FROM orders GROUP BY o_orderstatus")
_add("q_cte", lambda: (lambda big: (lambda per: select({"k": per.cust, "n": per.n}, with_cte(big, per), from_(per), where(gt(per.n, 3))))(cte("per", select({"cust": big.cust, "n": count()}, from_(big), group_by(big.cust)))))(cte("big", select({"cust": o.o_custkey, "price": o.o_totalprice}, from_(o), where(gt(o.o_totalprice, 100000))))),
     "SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1 HAVING count(*) > 3")
_add("q_derived", lambda: (lambda d: select({"segment": d.mktSegment, "n": d.n}, from_(d), where(gt(d.n, 1))))(alias(select({"mktSegment": c.c_mktsegment, "n": count()}, from_(c), group_by(c.c_mktsegment)), "d")),
     "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
for _kind, _op, _word in (("union", union, "UNION"), ("union_all", union_all, "UNION ALL"), ("intersect", intersect, "INTERSECT"), ("except", except_, "EXCEPT")):
    _add(f"q_{_kind}", lambda f=_op: f(select({"k": c.c_nationkey}, from_(c), where(gt(c.c_acctbal, 5000))), select({"k": s.s_nationkey}, from_(s), where(lt(s.s_acctbal, 1500)))),
         f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 {_word} SELECT s_nationkey FROM supplier WHERE s_acctbal < 1500")
_add("q_scalar", lambda: select({"k": o.o_orderkey}, from_(o), where(gt(o.o_totalprice, scalar(select({"a": average(o2.o_totalprice)}, from_(o2)))))), "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
o2 = alias(orders, "o2")
_add("q_corr_scalar", lambda: select({"k": c.c_custkey, "last": scalar(select({"d": maximum(o.o_orderkey)}, correlate(c), from_(o), where(eq(o.o_custkey, c.c_custkey))))}, from_(c)),
     "SELECT c_custkey AS k, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer")
_sub = lambda: select({"k": o.o_orderkey}, correlate(c), from_(o), where(and_(eq(o.o_custkey, c.c_custkey), gt(o.o_totalprice, 300000))))
_add("q_exists", lambda: select({"k": c.c_custkey}, from_(c), where(exists(_sub()))), "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_add("q_not_exists", lambda: select({"k": c.c_custkey}, from_(c), where(not_exists(_sub()))), "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_rich = lambda: select({"k": o.o_custkey}, from_(o), where(gt(o.o_totalprice, 300000)))
_add("q_in_query", lambda: select({"k": c.c_custkey}, from_(c), where(in_query(c.c_custkey, _rich()))), "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_add("q_not_in_query", lambda: select({"k": c.c_custkey}, from_(c), where(not_(in_query(c.c_custkey, _rich())))), "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_add("q_in_query_value", lambda: select({"k": n.n_nationkey, "hit": in_query(n.n_nationkey, select({"x": call("NULLIF", s.s_nationkey, value(3), domain=T.INTEGER)}, from_(s), where(gt(s.s_acctbal, 8500))))}, from_(n)),
     "SELECT n_nationkey AS k, n_nationkey IN (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_acctbal > 8500) AS hit FROM nation")
_top = lambda: select({"orderKey": o.o_orderkey, "price": o.o_totalprice}, correlate(c), from_(o), where(eq(o.o_custkey, c.c_custkey)), order_by(desc(o.o_totalprice), asc(o.o_orderkey)), limit(1))
_add("q_lateral", lambda: (lambda t: select({"k": c.c_custkey, "order": t.orderKey, "price": t.price}, from_(c), cross_join(t)))(lateral(_top(), "t")),
     """SELECT c_custkey AS k, o_orderkey AS "order", o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
_add("q_left_lateral", lambda: (lambda t: select({"k": c.c_custkey, "price": t.price}, from_(c), left_join(t, gt(t.price, 200000))))(lateral(_top(), "t")),
     "SELECT c_custkey AS k, max(CASE WHEN o_totalprice > 200000 THEN o_totalprice END) AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_large_lines = lambda: select({"one": lineitem.l_orderkey}, correlate(o, c), from_(lineitem), where(and_(eq(lineitem.l_orderkey, o.o_orderkey), gt(lineitem.l_quantity, 45), gt(lineitem.l_extendedprice, multiply(c.c_acctbal, 9)))))
_served_orders = lambda fields, *more: select(fields, correlate(c), from_(o), where(and_(eq(o.o_custkey, c.c_custkey), exists(_large_lines()), *more)))
_INNER = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_extendedprice > c_acctbal * 9)"
_add("q_two_levels_exists", lambda: select({"k": c.c_custkey}, from_(c), where(exists(_served_orders({"k": o.o_orderkey})))), f"SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_INNER})")
_add("q_two_levels_not_exists", lambda: select({"k": c.c_custkey}, from_(c), where(not_exists(_served_orders({"k": o.o_orderkey})))), f"SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_INNER})")
_add("q_two_levels_scalar", lambda: select({"k": c.c_custkey, "n": scalar(_served_orders({"n": count()}, gt(o.o_totalprice, 1000)))}, from_(c)), f"SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND {_INNER} AND o_totalprice > 1000) AS n FROM customer")
_add("q_two_levels_lateral", lambda: (lambda t: select({"k": c.c_custkey, "n": t.n}, from_(c), cross_join(t)))(lateral(_served_orders({"n": count()}), "t")), f"SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND {_INNER}) AS n FROM customer")
_add("q_case_cast_text", lambda: select(
    {"k": p.p_partkey, "band": case_when(lt(p.p_size, 10), "small", case_when(lt(p.p_size, 30), "mid", "big")), "txt": cast(p.p_size, text()), "num": cast(p.p_retailprice, bigint()), "raw": cast(p.p_size, "DOUBLE"), "names": concat(upper(p.p_brand), "-", lower(p.p_type)), "c": coalesce(call("NULLIF", p.p_brand, value("Brand#11"), domain=T.TEXT), "none")}, from_(p),
), """SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS band, CAST(p_size AS VARCHAR) AS txt, CAST(trunc(p_retailprice) AS BIGINT) AS num,
 CAST(p_size AS DOUBLE) AS raw, upper(p_brand) || '-' || lower(p_type) AS names, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS c FROM part""")
_add("q_arithmetic", lambda: select({"k": p.p_partkey, "a": add(p.p_size, 3), "b": subtract(p.p_size, 3), "c": multiply(p.p_size, 2), "d": divide(p.p_size, 4), "e": modulo(subtract(p.p_size, 20), 7)}, from_(p)),
     "SELECT p_partkey AS k, p_size + 3 AS a, p_size - 3 AS b, p_size * 2 AS c, p_size / 4 AS d, (p_size - 20) % 7 AS e FROM part")
_DOCS = """CASE event_id % 4 WHEN 0 THEN '{"user":{"name":"' || event_type || '","active":true,"email":null},"scores":[' || round(value, 1) || ']}'
 WHEN 1 THEN '{"user":{"name":42,"active":"yes"},"scores":["high"]}' WHEN 2 THEN '{"user":null}' ELSE props END"""
#: Events with documents in which a path is text, a number, a boolean, null or not there.
_docs = custom_source("docs", {"id": bigint(), "event_type": text(), "value": numeric(), "doc": json()}, lambda ctx: f"(SELECT event_id AS id, event_type, value, {_DOCS.replace('value', 'CAST(value AS DECIMAL(18, 6))')} AS doc FROM {ctx.table('events')}) AS {ctx.quote('docs')}")
_add("q_json", lambda: select({
    "k": _docs.id, "name": json_text(_docs.doc, ["user", "name"]), "score": json_number(_docs.doc, ["scores", 0]), "active": json_boolean(_docs.doc, ["user", "active"]), "email": json_exists(_docs.doc, ["user", "email"]), "num": json_number(_docs.doc, ["k"]), "there": json_exists(_docs.doc, ["k"]),
}, from_(_docs)), """SELECT event_id AS k, CASE WHEN event_id % 4 = 0 THEN event_type END AS name, CASE WHEN event_id % 4 = 0 THEN CAST(round(CAST(value AS DECIMAL(18, 6)), 1) AS DOUBLE) END AS score,
 CASE WHEN event_id % 4 = 0 THEN TRUE END AS active, event_id % 4 = 0 AS email, CASE WHEN event_id % 4 = 3 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS num, event_id % 4 = 3 AS there FROM events""")
_add("q_ilike", lambda: select({"k": n.n_nationkey}, from_(n), where(__import__("quillon.functions.comparison", fromlist=["ilike"]).ilike(n.n_name, "%1%"))), "SELECT n_nationkey AS k FROM nation WHERE n_name ILIKE '%1%'")
_add("q_source_free", lambda: select({"one": value(1), "word": value("x")}), "SELECT 1 AS one, 'x' AS word")
_range = custom_source("r", {"id": bigint()}, lambda ctx: f"RANGE({ctx.parameter(3)}, {ctx.parameter(9)}) AS {ctx.quote('r')}")
_add("q_custom_source", lambda: select({"k": _range.id}, from_(_range)), "SELECT range AS k FROM range(3, 9)")
_add("q_custom_clause", lambda: select({"k": n.n_nationkey}, from_(n), order_by(asc(n.n_nationkey)), custom_clause("first", 105, lambda ctx: f"LIMIT {ctx.parameter(4)}")), "SELECT n_nationkey AS k FROM nation ORDER BY 1 LIMIT 4")


def _mutated(change, give=None):
    """The table after a mutation, or the returned rows."""

    def run(spark, sf_dir):
        e = engine(spark, sf_dir)
        back = e.mutate(change())
        return back if give else e.tables["nation"]

    return run


QUERIES["q_update"] = _mutated(lambda: update(n, {"n_name": upper(n.n_name), "n_regionkey": add(n.n_regionkey, 10)}, where(eq(n.n_regionkey, 3))))
ORACLES["q_update"] = "SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN upper(n_name) ELSE n_name END AS n_name, CAST(CASE WHEN n_regionkey = 3 THEN n_regionkey + 10 ELSE n_regionkey END AS INTEGER) AS n_regionkey FROM nation"
QUERIES["q_update_returning"] = _mutated(lambda: update(n, {"n_regionkey": 0}, where(eq(n.n_regionkey, 2)), returning({"id": n.n_nationkey, "now": n.n_regionkey})), True)
ORACLES["q_update_returning"] = "SELECT n_nationkey AS id, CAST(0 AS INTEGER) AS now FROM nation WHERE n_regionkey = 2"
QUERIES["q_delete"] = _mutated(lambda: delete_from(n, where(gt(n.n_regionkey, 1))))
ORACLES["q_delete"] = "SELECT * FROM nation WHERE n_regionkey <= 1"
QUERIES["q_delete_all_returning"] = _mutated(lambda: delete_from(n, allow_all(), returning({"id": n.n_nationkey})), True)
ORACLES["q_delete_all_returning"] = "SELECT n_nationkey AS id FROM nation"
QUERIES["q_insert_values"] = _mutated(lambda: insert_into(n, values({"n_nationkey": 100, "n_name": "NEW", "n_regionkey": 1}, {"n_nationkey": 101, "n_name": "NEWER", "n_regionkey": add(value(1), 1)})))
ORACLES["q_insert_values"] = "SELECT * FROM nation UNION ALL SELECT 100, 'NEW', 1 UNION ALL SELECT 101, 'NEWER', 2"
QUERIES["q_insert_select"] = _mutated(lambda: insert_into(n, insert_select(select({"k": add(r.r_regionkey, 200), "v": r.r_name, "w": r.r_regionkey}, from_(r)), ["n_nationkey", "n_name", "n_regionkey"]), returning({"id": n.n_nationkey})), True)
ORACLES["q_insert_select"] = "SELECT CAST(r_regionkey + 200 AS INTEGER) AS id FROM region"


def _defaults(spark, sf_dir):
    t = table("audit", {"id": integer(identity=True), "kind": text(default=default_literal("none")), "note": text(nullable=True, has_default=True)})
    e = Engine(spark, {"audit": spark.createDataFrame([], "id int, kind string, note string")})
    e.mutate(insert_into(t, default_values()))
    e.mutate(insert_into(t, values({"kind": "x"}, {"kind": "y"})))
    return e.tables["audit"]


QUERIES["q_insert_defaults"] = _defaults
ORACLES["q_insert_defaults"] = "SELECT 1 AS id, 'none' AS kind, CAST(NULL AS VARCHAR) AS note UNION ALL SELECT 2, 'x', NULL UNION ALL SELECT 3, 'y', NULL"


def _generated(spark, sf_dir):
    """Generated and ON UPDATE columns follow an UPDATE; the rest of the rows stay."""
    own = table("prices", {"k": bigint(), "price": numeric(), "size": integer(), "version": integer()})
    t = table("prices", {"k": bigint(), "price": numeric(), "size": integer(), "total": numeric(generated_as=multiply(own.price, own.size)), "version": integer(on_update=add(own.version, 1))})
    e = Engine(spark, {"prices": spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k", "p_retailprice AS price", "p_size AS size", "p_retailprice * p_size AS total", "0 AS version")})
    e.mutate(update(t, {"size": add(t.size, 10)}, where(lt(t.size, 20))))
    e.mutate(update(t, {"price": multiply(t.price, 2)}, where(gt(t.size, 40))))
    return e.tables["prices"].selectExpr("k", "price", "size", "round(total, 2) AS total", "version")


QUERIES["q_update_generated"] = _generated
ORACLES["q_update_generated"] = """SELECT k, price, size, round(price * size, 2) AS total, version FROM (SELECT p_partkey AS k, CAST((p_size < 20)::INT + (s > 40)::INT AS INTEGER) AS version, CASE WHEN s > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS price, CAST(s AS INTEGER) AS size
 FROM (SELECT *, CASE WHEN p_size < 20 THEN p_size + 10 ELSE p_size END AS s FROM part))"""


def _identity_select(spark, sf_dir):
    """INSERT ... SELECT numbers the rows on from the largest id, without gaps."""
    t = table("rich", {"id": bigint(identity=True), "name": text(), "balance": numeric()})
    e = engine(spark, sf_dir)
    e.register("rich", spark.createDataFrame([(7, "first", 0.0)], "id long, name string, balance double"))
    e.mutate(insert_into(t, insert_select(select({"n": c.c_name, "b": c.c_acctbal}, from_(c), where(gt(c.c_acctbal, 0))), ["name", "balance"])))
    return e.tables["rich"].selectExpr("count(*) AS n", "min(id) AS low", "max(id) AS high", "count(DISTINCT id) AS ids", "round(sum(balance), 2) AS balance")


QUERIES["q_insert_identity_select"] = _identity_select
ORACLES["q_insert_identity_select"] = "SELECT count(*) + 1 AS n, CAST(7 AS BIGINT) AS low, count(*) + 7 AS high, count(*) + 1 AS ids, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 0"
