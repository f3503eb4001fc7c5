"""Every catalogued query against its SQL on DuckDB."""

import os

import duckdb
import pytest

from quillon.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if os.path.isfile(f"{SF}/{f}"):
            c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def norm(rows):
    plain = lambda x: round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(map(plain, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert norm(tuple(r[c] for c in cols) for r in df.collect()) == norm(cur.fetchall())
