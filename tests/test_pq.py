import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.operators import pq, search
from test_ivf import clustered, rows  # noqa: F401


@pytest.mark.parametrize(("k", "exclude_self"), [(1, False), (10, False), (10, True), (40, False)])
def test_equals_the_whole_search_and_rescores_little(spark, clustered, k, exclude_self):  # noqa: F811
    index = pq.build_pq(clustered, parts=8, sample_rows=500)
    assert index.rows == clustered.count() - 3  # null, another length, NaN
    queries = clustered.where("id % 50 = 0 or id = 5003 or id in (9001, 9003)")
    got = pq.search_pq(index, queries, k, exclude_self=exclude_self)
    want = search.search(queries.where("id <> 9003"), clustered, k, "blocks", exclude_self=exclude_self)
    assert got.columns == want.columns
    assert rows(got) == rows(want)
    assert 0 < index.rescored < 0.5 * index.pairs


def test_short_lists(spark, clustered):  # noqa: F811
    """Nine of ten hits over all given vectors, scoring 50 of 2,000 from their vectors; with a long enough list all."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = given.where("id % 50 = 0")
    index = pq.build_pq(given)
    pairs = lambda hits: {(r.query_id, r.db_id) for r in hits.collect()}
    want = pairs(search.search(queries, given, 10, "blocks"))
    assert len(pairs(pq.search_pq(index, queries, 10, shortlist=50)) & want) >= 0.9 * len(want)
    assert index.rescored == 50 * queries.count() == 0.025 * index.pairs
    queries = clustered.where("id % 50 = 0 and id < 5000")
    assert rows(pq.search_pq(pq.build_pq(clustered), queries, 10, shortlist=5000)) == rows(search.search(queries, clustered, 10, "blocks"))


def test_zero_queries_repeated_ids_blocks_and_slices(spark, clustered, monkeypatch):  # noqa: F811
    index = pq.build_pq(clustered, parts=5)
    odd = clustered.where("id in (1, 2, 9002, 9004)").union(clustered.where("id = 2"))
    one = rows(search.search(odd.where("id <> 9004").distinct(), clustered, 5, "native"))
    want = sorted(one + [x for x in one if x[0] == 2])
    assert rows(pq.search_pq(index, odd, 5)) == want
    assert rows(pq.search_pq(index, odd, 5, block_values=20)) == want
    monkeypatch.setattr(pq, "_BROADCAST_PAIRS", 0)
    monkeypatch.setattr(pq, "_PAIRS", 7)
    assert rows(pq.search_pq(index, odd, 5)) == want


def test_few_rows_none_and_no_structure(spark, clustered):  # noqa: F811
    few = clustered.where("id < 4")
    assert rows(pq.search_pq(pq.build_pq(few, parts=40), few, 10)) == rows(search.search(few, few, 10, "blocks"))
    assert pq.search_pq(pq.build_pq(clustered.limit(0)), few, 3).count() == 0
    draw = np.random.default_rng(3)
    df = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(draw.normal(size=(300, 8)).astype(np.float32))], "id string, embedding array<float>")
    got = pq.search_pq(pq.build_pq(df, parts=4), df.limit(20), 7)
    assert got.orderBy("query_id", "rank").collect() == search.search(df.limit(20), df, 7, "blocks").orderBy("query_id", "rank").collect()


def test_codes_alone_are_scanned(spark, clustered):  # noqa: F811
    index = pq.build_pq(clustered)
    plan = index.table(spark).select("row", "codes", "error")._jdf.queryExecution().toString()
    assert "embedding" not in plan.split("ReadSchema")[1]


def test_best_of_each_place_with_ties():
    place, score = np.array([2, 1, 2, 2, 1, 2]), np.array([0.5, 0.1, 0.9, 0.5, 0.2, 0.4])
    assert sorted(pq._best_of(place, score, 2).tolist()) == [0, 1, 2, 3, 4]
    assert sorted(pq._best_of(place, score, 1).tolist()) == [2, 4]
    assert not len(pq._best_of(place[:0], score[:0], 3))


def test_what_a_task_holds_does_not_grow_with_the_queries(spark, monkeypatch):
    """Without structure nearly all pairs are candidates: they leave their batch only as its best, and look-up tables are those of
    few queries."""
    from test_metrics import _rows_of

    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(1500, 8)).astype(np.float32))], "id long, embedding array<float>").repartition(2)
    index, queries = pq.build_pq(df, parts=2, sample_rows=300), df.where("id % 3 = 0")
    sent, plain = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda own, value: sent.append(value) or plain(value))
    got = pq.search_pq(index, queries, 5)
    numbers = lambda value: sum(map(numbers, value)) if isinstance(value, (tuple, list)) else np.size(value)
    assert sent and max(map(numbers, sent)) < 500 * (8 + 4) + 2 * 256 * 8  # queries and books, not 500 x 2 x 256 look-up scores
    monkeypatch.undo()
    assert rows(got) == rows(search.search(queries, df, 5, "blocks"))
    assert max(_rows_of(got._jdf.queryExecution().executedPlan())) < index.rescored / 4
