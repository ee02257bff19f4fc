"""Registered training-data queries against their DuckDB SQL."""

import duckdb
import pytest
from conftest import SF001
from presslens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF001)
    cols = sorted(df.columns)
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want
