import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.functions import vector
from strandsift.operators import search

SCHEMA = "id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((r.query_id, r.rank, r.db_id) for r in df.collect())


@pytest.fixture(scope="module")
def database(spark):
    draw = np.random.default_rng(1)
    own = [(i, (draw.normal(size=8) * draw.uniform(0.1, 5)).astype(np.float32).tolist()) for i in range(200)]
    own += [(200, own[3][1]), (201, [2 * x for x in own[3][1]]), (202, [0.0] * 8), (203, [math.nan] * 8), (204, None), (205, [1.0, 2.0])]
    return frame(spark, own).repartition(3).cache()


def brute(database, ids, k, exclude_self=False):
    data = {r.id: np.array(r.embedding, float) for r in database.collect() if r.embedding and len(r.embedding) == 8}
    unit = {i: v / (np.linalg.norm(v) + 1e-12) for i, v in data.items()}
    out = []
    for q in ids:
        s = sorted((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if not np.isnan(v).any() and not (exclude_self and i == q))
        out += [(q, r, i) for r, (_, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("strategy", ["native", "blocks", "auto"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_search_equals_brute_force(database, strategy, exclude_self):
    queries = database.where("id in (3, 7, 150, 202)")
    assert rows(search.search(queries, database, 12, strategy, exclude_self)) == brute(database, (3, 7, 150, 202), 12, exclude_self)


def test_ties_go_to_the_smaller_id(database):
    found = search.search(database.where("id = 3"), database, 3, "blocks").orderBy("rank").collect()
    assert [r.db_id for r in found] == [3, 200, 201]


def test_more_than_the_database_has(spark, database):
    few = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert search.search(few, few, 10).count() == 4
    with pytest.raises(ValueError):
        search.search(few, few, 10, strict=True)


def test_empty_sides(spark, database):
    none = frame(spark, [])
    for strategy in ("native", "blocks"):
        assert search.search(none, database, 5, strategy).count() == 0
        assert search.search(database.where("id = 3"), none, 5, strategy).count() == 0


def test_other_columns_may_clash(database):
    extra = database.withColumn("score", F.lit("x")).withColumn("db_id", F.lit(1)).withColumn("rank", F.lit(2))
    assert rows(search.search(extra.where("id = 7"), extra, 4, "blocks")) == brute(database, (7,), 4)


def test_normalise(spark):
    got = {r.id: r.v for r in frame(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])]).select("id", vector.l2_normalize(F.col("embedding")).alias("v")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0] and got[3] is None and got[4] == []


def test_top_k_skips_nan(spark):
    s = spark.createDataFrame([(1, 1, math.nan), (1, 2, 0.5), (1, 3, 0.7), (1, 4, None)], "query_id long, db_id long, score double")
    assert rows(search.top_k(s, 5)) == [(1, 1, 3), (1, 2, 2)]


def test_gather_keeps_repeats_and_drops_missing(spark, database):
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 9999)], "query_id long, rank int, db_id long")
    assert search.gather(hits, database).count() == 2


def test_half_precision(spark):
    got = frame(spark, [(1, [0.1, 1.0]), (2, None)]).select("id", vector.quantise_fp16(F.col("embedding")).alias("h")).orderBy("id").collect()
    assert got[0].h == pytest.approx(np.array([0.1, 1.0], np.float16).astype(float).tolist()) and got[1].h is None


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "h array<array<double>>, m array<double>")
    r = df.select(vector.mean_pool(F.col("h"), F.col("m")).alias("mean"), vector.cls_pool(F.col("h")).alias("cls")).first()
    assert r["mean"] == [2.0, 3.0] and r.cls == [1.0, 2.0]


def test_plan_limits_groups_early(database):
    plan = search.search(database.where("id = 3"), database, 5, "native")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" in plan


def test_stream_search(spark, database, tmp_path):
    from strandsift.streaming.search import stream_search

    database.where("id < 5").write.parquet(str(tmp_path / "q"))
    got = []
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "q"))
    stream_search(stream, database, lambda df, n: got.extend(rows(df)), k=3, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert sorted(got) == brute(database, range(5), 3)


@pytest.mark.parametrize("strategy", ["native", "blocks"])
def test_blocks_of_queries_give_the_same_rows(spark, strategy):
    draw = np.random.default_rng(7)
    df = spark.createDataFrame([(i, draw.normal(size=8).tolist()) for i in range(60)], "id long, embedding array<double>")
    queries = df.where("id % 3 = 0")
    rows = lambda out: sorted((r.query_id, r.db_id, getattr(r, "rank", 0), round(r.score, 9)) for r in out.collect())
    assert rows(search.search(queries, df, 5, strategy, block_values=40)) == rows(search.search(queries, df, 5, strategy))
    for f in (search.dot_scores, search.cosine_scores):
        assert rows(f(queries, df, 40)) == rows(f(queries, df))


def test_scores_of_null_and_unlike_vectors_are_null(spark):
    """As with SQL's dot product, in slices of rows; no pair is left out."""
    db = frame(spark, [(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, []), (5, [0.0, 0.0]), (6, [math.nan, 1.0])])
    for f, want in ((search.dot_scores, 25.0), (search.cosine_scores, 1.0)):
        got = {(r.query_id, r.db_id): r.score for r in f(db, db).collect()}
        assert len(got) == 36 and got[1, 1] == pytest.approx(want) and got[5, 1] == got[4, 4] == 0.0 and math.isnan(got[6, 1])
        assert all(got[a, b] is None for a, b in ((1, 2), (2, 2), (1, 3), (3, 4), (4, 1)))
        assert "NestedLoopJoin" not in f(db, db)._jdf.queryExecution().executedPlan().toString()


def test_top_k_dot_equals_all_scores(spark, database):
    queries = database.where("id in (3, 7, 150, 202)")
    want = rows(search.top_k(search.dot_scores(queries, database), 9))
    out = search.top_k_dot(queries, database, 9)
    assert rows(out) == want and "NestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("exclude_self", [False, True])
def test_native_sorts_few_of_many_pairs(spark, exclude_self):
    """124,000 pairs and more, of which no operator has as many rows; odd vectors, repeated and null ids, two lengths."""
    from test_metrics import _rows_of

    draw = np.random.default_rng(5)
    own = [(i % 1990, draw.normal(size=6).astype(np.float32).tolist()) for i in range(2000)] + [(3000 + i, draw.normal(size=5).tolist()) for i in range(40)]
    own += [(5000 + i, own[7][1]) for i in range(30)] + [(6000, None), (6001, [math.nan] * 6), (6002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (6003, [0.0] * 6), (6004, [math.inf] * 6), (None, own[9][1])]
    df = frame(spark, own).repartition(3)
    queries = df.where("id % 33 = 7 or id in (3001, 6001, 6002, 6003, 6004)")
    got = search.search(queries, df, 9, "native", exclude_self)
    shown = lambda out: sorted((r.query_id, r.rank, -1 if r.db_id is None else r.db_id, round(r.score, 9)) for r in out.collect())
    pairs = queries.count() * df.count()
    assert pairs > 4 * search._NATIVE_PAIRS
    assert shown(got) == shown(search.search(queries.where("id not in (6002)"), df.where("id is null or id <> 6002"), 9, "blocks", exclude_self))
    assert max(_rows_of(got._jdf.queryExecution().executedPlan())) < pairs / 4
