"""Every query with an oracle, against DuckDB on the sf0.001 tables (the driver
runs the same comparison at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from stockroom.sources.tables import TABLES

from .conftest import SF_SMOKE

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMOKE)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=_key)
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = sorted((tuple(_norm(r[i]) for i in order) for r in cur.fetchall()), key=_key)
    assert len(srows) == len(drows)
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["sku", "abc_class", "xyz_class", "reorder_point", "recommended_order_qty", "safety_stock", "current_inventory", "recommendation"]


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 60
