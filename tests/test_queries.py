"""Every query against its DuckDB counterpart, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from memlake import registry
from memlake.sources.tables import NAMES

DIR = os.environ.get("MEMLAKE_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:19]
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted([tuple(str(plain(r[i])) for i in order) for r in rows])


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    want = duck.execute(sql)
    assert table(got.columns, got.collect()) == table([d[0] for d in want.description], want.fetchall())


def test_every_counterpart_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.queries()
