"""Every query with SQL equals DuckDB on the smallest tables."""

import duckdb
import pytest

from lexiloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_equals_sql(spark, tables, name):
    df = registry.queries()[name](spark, DATA)
    result = tables.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(result.fetchall(), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want
