"""Every query with SQL against DuckDB on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import pytest

from tallyspark.catalog import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    def plain(x):
        if isinstance(x, (float, Decimal)):
            return "nan" if math.isnan(x) else round(float(x), 5)
        return x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).is_dir():
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rows = got.collect()
    assert rows or name == "store_keys"
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(rows, got.columns) == canonical(want.fetchall(), want.columns)
