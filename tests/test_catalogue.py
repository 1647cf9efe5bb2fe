"""Every query of the catalogue against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from quillon import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def comparable(v):
    if isinstance(v, float) and not math.isnan(v):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(map(comparable, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(comparable, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["order_asc", "order_desc_two", "order_unselected", "order_star", "group_order"])
def test_order(spark, duck, name):
    """The sort keys come in the order that DuckDB gives."""
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    key = {"order_asc": "customer_c_acctbal", "order_star": "supplier_s_acctbal"}.get(name)
    got, expected = catalogue.QUERIES[name](spark, DIR).select(*columns).collect(), want.fetchall()
    at = [columns.index(key)] if key else range(len(columns))
    assert [[comparable(r[i]) for i in at] for r in got] == [[comparable(r[i]) for i in at] for r in expected]
