"""Correlated queries on Spark: pages by the order of their terms, and two levels without a product of the tables."""

import re

import pytest

import quillon as q
from quillon.plans.catalog import QUERIES

SF = "/root/testdata/sf0.01"
groups, items = q.table("groups", {"g": q.integer()}), q.table("items", {"k": q.integer(), "g": q.integer(), "v": q.integer(nullable=True)})
GROUPS = [1, 2, 3, 4]
ITEMS = [(i, i % 3 + 1, None if i % 7 == 0 else i * 5 % 11) for i in range(40)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def small(spark):
    return q.Engine(spark, {"groups": spark.createDataFrame([(g,) for g in GROUPS], "g int"), "items": spark.createDataFrame(ITEMS, "k int, g int, v int").repartition(7)})


@pytest.mark.parametrize("name", ["q_lateral", "q_left_lateral"])
def test_the_first_row_of_a_lateral_is_found_by_an_ordered_window(spark, name):
    windows = re.findall(r"row_number\(\) windowspecdefinition\((.*?), specifiedwindowframe", plan(QUERIES[name](spark, SF)))
    assert windows and all("DESC" in w and "ASC" in w for w in windows)


def page_of(skip, n, *more):
    terms = q.order_by(q.nulls_last(items.v), q.desc(items.k))
    return q.select({"k": items.k, "v": items.v}, q.correlate(groups), q.from_(items), q.where(q.eq(items.g, groups.g)), terms, q.offset(skip), q.limit(n), *more)


@pytest.mark.parametrize("skip, n", [(0, 1), (2, 3), (0, 0), (12, 5)])
def test_pages_of_a_lateral(small, skip, n):
    t = q.lateral(page_of(skip, n), "t")
    df = small.dataframe(q.select({"g": groups.g, "k": t.k}, q.from_(groups), q.cross_join(t)))
    of = lambda g: sorted((r for r in ITEMS if r[1] == g), key=lambda r: (r[2] is None, r[2] or 0, -r[0]))
    assert sorted(map(tuple, df.collect())) == sorted((g, r[0]) for g in GROUPS for r in of(g)[skip : skip + n])
    assert n == 0 or "windowspecdefinition(_s" in re.sub(r"g#\d+, ", "", plan(df))


def test_a_page_of_groups_and_of_distinct_rows(small):
    most = q.select({"v": items.v}, q.correlate(groups), q.from_(items), q.where(q.eq(items.g, groups.g)), q.group_by(items.v), q.having(q.gt(q.count(), 1)), q.order_by(q.desc(q.count()), q.desc(items.v)), q.limit(1))
    second = q.select({"v": items.v}, q.correlate(groups), q.from_(items), q.where(q.and_(q.eq(items.g, groups.g), q.is_not_null(items.v))), q.distinct(), q.order_by(q.desc(items.v)), q.offset(1), q.limit(1))
    a, b = q.lateral(most, "a"), q.lateral(second, "b")
    got = {r.g: (r.a, r.b) for r in small.dataframe(q.select({"g": groups.g, "a": a.v, "b": b.v}, q.from_(groups), q.left_join(a, q.is_not_null(groups.g)), q.left_join(b, q.is_not_null(groups.g)))).collect()}
    for g in GROUPS:
        own = [r[2] for r in ITEMS if r[1] == g]
        often = sorted(((own.count(v), -1 if v is None else v) for v in set(own) if own.count(v) > 1), reverse=True)
        distinct = sorted({v for v in own if v is not None}, reverse=True)
        first = (often[0][1] if often[0][1] >= 0 else None) if often else None
        assert got[g] == (first, distinct[1] if len(distinct) > 1 else None)


def paired(df):
    """Joins without a condition."""
    return re.findall(r"Join (?:Inner|Cross)\s*$", plan(df), re.M)


@pytest.mark.parametrize("name", ["q_two_levels_exists", "q_two_levels_lateral", "q_two_levels_not_exists", "q_two_levels_scalar"])
def test_two_levels_make_no_product(spark, name):
    assert not paired(QUERIES[name](spark, SF))
