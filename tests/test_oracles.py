"""Every query with SQL gives the same rows as the SQL on the smallest tables."""

import os

import duckdb
import pytest

from receptorium.plans import bridge
from receptorium.plans.oracles import ORACLES
from receptorium.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in bridge.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sql, name):
    df = QUERIES[name](spark, SF)
    result = sql.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
