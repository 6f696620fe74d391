import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.operators import ivf, search


@pytest.fixture(scope="module")
def clustered(spark):
    """2,000 vectors round 12 directions, one of which holds a third; repeated vectors; odd rows."""
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16))
    own = np.where(draw.random(2000) < 0.33, 0, draw.integers(0, 12, 2000))
    x = (centres[own] + 0.15 * draw.normal(size=(2000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[7].tolist()) for i in range(30)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [1.0, 2.0]), (9004, [float("nan")] * 16), (None, x[3].tolist())]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5).cache()


def rows(df):
    return sorted((r.query_id, r["rank"], r.db_id if r.db_id is not None else -1, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize(("k", "exclude_self"), [(1, False), (10, False), (10, True), (40, False)])
def test_equals_the_whole_search_and_prunes(spark, clustered, k, exclude_self):
    index = ivf.build_index(clustered, clusters=24, sample_rows=500)
    assert index.rows.sum() == clustered.count() - 3  # null, another length, NaN
    queries = clustered.where("id % 50 = 0 or id = 5003 or id in (9001, 9003)")
    got = ivf.search_index(index, queries, k=k, exclude_self=exclude_self)
    want = search.search(queries.where("id not in (9003)"), clustered, k, "blocks", exclude_self=exclude_self)
    assert got.columns == want.columns
    assert rows(got) == rows(want)
    assert 0 < index.scored < 0.5 * index.pairs


def test_zero_queries_repeated_ids_and_blocks(spark, clustered):
    index = ivf.build_index(clustered, clusters=9)
    odd = clustered.where("id in (1, 2, 9002)").union(clustered.where("id = 2"))
    want = rows(search.search(odd.distinct(), clustered, 5, "native"))
    assert rows(ivf.search_index(index, odd, k=5)) == rows(ivf.search_index(index, odd, k=5, block_values=20))
    assert rows(ivf.search_index(index, odd, k=5)) == sorted(want + [x for x in want if x[0] == 2])


def test_vectors_without_any_structure(spark):
    """Where bounds prune nothing, rows are the same nonetheless."""
    draw = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(300, 8)).astype(np.float32))], "id long, embedding array<float>")
    index = ivf.build_index(df, clusters=5)
    queries = df.where("id < 20")
    assert rows(ivf.search_index(index, queries, k=7)) == rows(search.search(queries, df, 7, "blocks"))


def test_fewer_rows_than_k_and_none_at_all(spark, clustered):
    few = clustered.where("id < 4")
    index = ivf.build_index(few, clusters=3)
    assert rows(ivf.search_index(index, few, k=10)) == rows(search.search(few, few, 10, "blocks"))
    none = ivf.build_index(clustered.limit(0))
    assert ivf.search_index(none, few, k=3).count() == 0


def test_unneeded_partitions_are_not_read(spark, clustered):
    index = ivf.build_index(clustered, clusters=24)
    table = spark.read.schema("id long, embedding array<float>, distance double, cluster int").parquet(index.path)
    assert "PartitionFilters: [cluster" in table.where(F.col("cluster").isin([1, 2]))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
