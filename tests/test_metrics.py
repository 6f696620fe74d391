import math
import random

import pytest

from strandsift.operators import metrics


def frames(spark, retrieved, relevant):
    q = spark.createDataFrame([(i,) for i in range(len(retrieved))], "query_id long")
    h = spark.createDataFrame([(i, r, x) for i, row in enumerate(retrieved) for r, x in enumerate(row, 1)], "query_id long, rank int, db_id long")
    t = spark.createDataFrame([(i, x) for i, row in enumerate(relevant) for x in row], "query_id long, db_id long")
    return q, h, t


def stated(retrieved, relevant, k):
    """The definitions, in plain Python."""
    n = len(retrieved)
    out = dict.fromkeys(("recall", "precision", "mrr", "ndcg", "map"), 0.0)
    for got, want in zip(retrieved, map(set, relevant), strict=True):
        hits = len(set(got[:k]) & want)
        out["precision"] += hits / k if k else 0
        if not want:
            continue
        out["recall"] += hits / len(want)
        out["mrr"] += next((1 / r for r, x in enumerate(got, 1) if x in want), 0)
        ideal = sum(1 / math.log2(i + 2) for i in range(min(k, len(want))))
        out["ndcg"] += sum(1 / math.log2(i + 2) for i, x in enumerate(got[:k]) if x in want) / ideal if ideal else 0
        seen = total = 0
        for r, x in enumerate(got, 1):
            if x in want:
                seen += 1
                total += seen / r
        out["map"] += total / len(want)
    return {m: v / n if n else 0.0 for m, v in out.items()}


CASES = [
    ([[1, 2, 3], [4, 4, 5], [], [6]], [[2, 9], [4], [7], []]),
    ([[1]], [[]]),
    ([[5, 5, 5, 1]], [[1, 5]]),
]


@pytest.mark.parametrize("case", range(4))
@pytest.mark.parametrize("k", [0, 1, 2, 10])
def test_against_definitions(spark, case, k):
    if case == 3:
        random.seed(k)
        retrieved = [[random.randrange(12) for _ in range(random.randrange(9))] for _ in range(20)]
        relevant = [[random.randrange(12) for _ in range(random.randrange(5))] for _ in range(20)]
    else:
        retrieved, relevant = CASES[case]
    f, want = frames(spark, retrieved, relevant), stated(retrieved, relevant, k)
    assert metrics.recall_at_k(*f, k).first()[0] == pytest.approx(want["recall"])
    assert metrics.precision_at_k(*f, k).first()[0] == pytest.approx(want["precision"])
    assert metrics.ndcg_at_k(*f, k).first()[0] == pytest.approx(want["ndcg"])
    assert metrics.mean_reciprocal_rank(*f).first()[0] == pytest.approx(want["mrr"])
    assert metrics.mean_average_precision(*f).first()[0] == pytest.approx(want["map"])


def test_no_queries(spark):
    f = frames(spark, [], [])
    got = {r.metric: r.value for r in metrics.retrieval_metrics(*f).collect()}
    assert set(got.values()) == {0.0} and "ndcg@10" in got and "ndcg@5" not in got and "precision@100" in got


def test_relevance(spark):
    db = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["z"]), (3, "b", ["y", "x"]), (4, None, None)], "id long, label string, annotations array<string>")
    pairs = lambda df: sorted((r.query_id, r.db_id) for r in df.collect())
    assert pairs(metrics.family_relevance(db, db)) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    assert pairs(metrics.annotation_relevance(db, db)) == [(1, 1), (1, 3), (2, 2), (3, 1), (3, 3)]


def test_exact_match_counts_queries_without_hits(spark):
    q = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "id long, name string")
    hits = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (1, 2, 11)], "query_id long, rank int, db_id long")
    db = spark.createDataFrame([(10, "p"), (11, "x")], "id long, name string")
    assert metrics.exact_match_recovery(hits, q, db).first()[0] == pytest.approx(1 / 3)


def test_ranking_metrics(spark):
    rows = [(i, [float(i % 3 == j) + 0.01 * i for j in range(3)], i % 3, [f"g{i % 2}"], f"n{i}") for i in range(12)]
    db = spark.createDataFrame(rows, "id long, embedding array<float>, label int, annotations array<string>, name string")
    got = {(r.task, r.metric): r.value for r in metrics.ranking_metrics(db, db, (1, 5)).collect()}
    assert got["exact_match", "exact_match"] == 1.0 and got["family", "recall@1"] == pytest.approx(0.25) and ("annotation", "map") in got


def test_annotation_pairs_come_once_without_a_distinct(spark):
    """Many shared annotations, one of them on all rows; repeated ids and notes; null notes and arrays."""
    rows = [(i, ["all", f"n{i % 3}", f"m{i % 4}", None, "all"]) for i in range(40)] + [(3, ["own"]), (50, ["own"]), (51, None), (52, [None]), (53, [])]
    df = spark.createDataFrame(rows, "id long, annotations array<string>")
    got = metrics.annotation_relevance(df.where("id % 5 = 3 or id > 49"), df)
    by = {}
    for i, notes in rows:
        by.setdefault(i, set()).update(x for x in notes or () if x is not None)
    want = sorted((a, b) for a in by for b in by if (a % 5 == 3 or a > 49) and by[a] & by[b])
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # nothing is aggregated above the join


def test_judgements_equal_pairs_without_making_them(spark):
    """Repeated ids, several and null annotations, labels that only one side has: as with all pairs, of which none is made."""
    random.seed(6)
    rows = [(i % 50, random.choice([None, 0, 1, 2, 50 + i]), [random.choice(["x", "y", "z", f"own{i % 7}", None]) for _ in range(random.randrange(4))] or None) for i in range(60)]
    db = spark.createDataFrame(rows, "id long, label int, annotations array<string>")
    q = db.where("id % 3 = 0").unionByName(spark.createDataFrame([(900, 7, ["none"])], db.schema))
    hits = spark.createDataFrame([(a, r, random.randrange(55)) for a in range(0, 50, 3) for r in range(1, 9)], "query_id long, rank int, db_id long")
    asked = q.select("id").distinct().withColumnRenamed("id", "query_id")
    shown = lambda relevant: sorted(tuple(round(x, 9) for x in r) for r in metrics.per_query(asked, hits, relevant, (1, 5)).collect())
    assert shown(metrics.family_judgement(q, db)) == shown(metrics.family_relevance(q, db))
    assert shown(metrics.annotation_judgement(q, db)) == shown(metrics.annotation_relevance(q, db))


@pytest.mark.parametrize("name", ["ndcg_at_k", "evaluate_families", "evaluate_annotations"])
def test_no_join_makes_all_relevant_pairs(spark, tmp_path, name):
    """4,000 rows of one label, 80 of them queries: 320,000 relevant pairs, of which no operator has as many rows."""
    from strandsift.plans import registry

    vectors = spark.range(4000).selectExpr("id vec_id", "array(cast(sin(id) as float), cast(cos(id) as float)) embedding", "1 label")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.queries()[name](spark, str(tmp_path))
    rows = out._jdf.queryExecution()
    out.collect()
    found = [int(x) for x in _rows_of(rows.executedPlan())]
    assert found and max(found) < 100_000


def _rows_of(plan):
    """numOutputRows of the operators of a plan that has run."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from _rows_of(plan.executedPlan())
        return
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        yield from _rows_of(plan.plan())
    if plan.metrics().contains("numOutputRows"):
        yield plan.metrics().apply("numOutputRows").value()
    for i in range(plan.children().size()):
        yield from _rows_of(plan.children().apply(i))


@pytest.mark.parametrize("small", [200_000, 5, 0])
def test_annotation_pairs_are_only_made_where_they_are_results(spark, monkeypatch, small):
    """Annotations are compared by class, before any pair of rows is made; with tables that are sent to all tasks, or not."""
    monkeypatch.setattr(metrics, "_SMALL", small)
    random.seed(8)
    rows = [(i % 70, [random.choice(["x", "y", "z", "all", f"own{i % 9}", None]) for _ in range(random.randrange(5))]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, annotations array<string>")
    by = {}
    for i, notes in rows:
        by.setdefault(i, set()).update(x for x in notes if x is not None)
    out = metrics.annotation_relevance(df.where("id % 5 = 3"), df)
    assert sorted(map(tuple, out.collect())) == sorted((a, b) for a in by for b in by if a % 5 == 3 and by[a] & by[b])
    assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_one_class_follow_each_other(spark):
    """Each task gives the pairs of one class of queries together, so that files hold the repeating ids in little room."""
    rows = [(i, [f"a{i % 5}", "b"]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, annotations array<string>")
    out = metrics.annotation_relevance(df.where("id < 50"), df)
    parts = [[r.query_id % 5 for r in p] for p in out.rdd.glom().collect()]
    assert sum(map(len, parts)) == out.distinct().count() == 50 * 400
    assert all(sum(x != y for x, y in zip(p, p[1:])) < 5 for p in parts)
