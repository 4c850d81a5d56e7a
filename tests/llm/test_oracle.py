"""The operators' queries against their SQL."""

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    got = sorted(map(tuple, df.collect()))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert got == sorted(want) and len(got) == 1000
