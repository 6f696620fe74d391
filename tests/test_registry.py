"""Every query of the search engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from strandsift.plans import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("embeddings", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(rows):
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    return sorted((tuple(float(x) if isinstance(x, float) else x for x in r) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = plain(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    want = plain(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_texts_are_encoded_and_aligned(spark, tmp_path):
    """What lies behind the first 1,022 and 1,024 letters counts."""
    head = "ACDEFGHIKL" * 150
    spark.createDataFrame([(0, head + "WWWWYYYYWWWW" * 9), (1, head)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "WWWWYYYYWWWW" * 9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert len({r.norm for r in run("encode_kmer")}) == 2
    for name in ("sw_scores", "sw_rerank"):
        scores = {r.db_id: r.sw_score for r in run(name)}
        assert scores[0] > scores[1] >= 0
    assert run("sw_pairs")[0].sw_score == scores[0]


@pytest.mark.parametrize("name", ["sw_rerank", "sw_seeded"])
def test_every_item_is_asked(spark, duck, name):
    """No item of the benchmark is left out."""
    want = {r[0] for r in duck.sql("SELECT item_id FROM benchmark WHERE length(text) > 2").fetchall()}
    assert {r.query_id for r in registry.queries()[name](spark, FOLDER).select("query_id").distinct().collect()} == want
