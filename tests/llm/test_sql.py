import duckdb
import pytest

from strandsift.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df = queries.queries()[name](spark, small)
    columns = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall())
