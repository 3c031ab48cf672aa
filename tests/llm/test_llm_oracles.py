"""The queries that have SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from tallyspark.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    told = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == told
