"""The driver's contract: names agree, queries run on the smallest tables and give what their SQL gives."""

import math
import os

import pytest

import __spark_entry__ as contract
from brainweave.plans import catalog

SF = "/root/testdata/sf0.001"
CATALOG = catalog.queries()


def test_names_agree():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and set(CATALOG) <= set(queries)
    assert catalog.FLAGSHIP in CATALOG


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return tuple(value) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CATALOG)
def test_query_agrees_with_its_sql(spark, duck, name):
    df = CATALOG[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in result), key=repr)


def test_entry_is_the_flagship(spark):
    if os.path.isdir(SF):
        assert contract.entry(spark).columns == ["artifact", "chunk", "score", "sources"]
