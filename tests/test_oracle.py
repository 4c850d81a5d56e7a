"""Each registered query of the engine against its SQL, on small tables on which all cells are filled."""

import math

import duckdb
import pytest

from tessera.plans import queries as core

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found):
    clean = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in found]
    return sorted(clean, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*columns).collect())
    asked = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({core.SQL[name]})")
    want = rows(asked.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6 for x, y in zip(a, b)), (a, b)
