"""Every registered query runs at sf0.001, and every oracle SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from presslens.plans import registry
from presslens.sources.fixtures import BASE_TABLES

SF = "/root/testdata/sf0.001"
E.queries()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES  # the training-data queries have tests of their own


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "share" in df.columns


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_norm(row[i]) for i in idx) for row in rel.fetchall()), key=repr)
    assert got == want
