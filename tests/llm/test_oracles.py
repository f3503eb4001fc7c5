"""The corpus queries against their SQL on DuckDB."""

import os

import duckdb
import pytest

from quillon.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        if os.path.isfile(f"{SF}/{f}"):
            c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    cur = c.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "INTEGER": "int"}
    assert {d[0]: kinds[str(d[1])] for d in cur.description} == dict(df.dtypes)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    assert sorted((tuple(plain(r[k]) for k in cols) for r in df.collect()), key=str) == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)
