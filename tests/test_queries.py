import duckdb
import pytest

from sluiceway.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, con, sf, name):
    query, sql = QUERIES[name]
    df = query(spark, sf)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda rs: sorted(map(repr, rs))
    assert rows(map(tuple, df.select(*columns).collect())) == rows(want.fetchall())
