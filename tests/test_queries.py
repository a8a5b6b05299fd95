"""Every registered query of the core against its SQL, over whole small tables."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from caseloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {n: q for m in registry.modules() for n, q in m.QUERIES.items()}
SQL = {n: q for m in registry.modules() for n, q in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == columns
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
