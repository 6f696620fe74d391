import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandsift.functions.substitution import SubstitutionMatrix, parity, standard
from strandsift.operators import align

A = "ACDEFGHIKLMNPQRSTVWY"


def naive(q, d, m, go, ge):
    h = np.zeros((len(q) + 1, len(d) + 1), int)
    e, f = np.full(h.shape, -10000), np.full(h.shape, -10000)
    for i in range(1, len(q) + 1):
        for j in range(1, len(d) + 1):
            e[i, j] = max(e[i - 1, j] - ge, h[i - 1, j] - go)
            f[i, j] = max(f[i, j - 1] - ge, h[i, j - 1] - go)
            h[i, j] = max(0, h[i - 1, j - 1] + m.score(q[i - 1], d[j - 1]), e[i, j], f[i, j])
    return int(h.max())


@pytest.mark.parametrize(("q", "d", "want"), [(A, A, 116), (A, A + A, 116), ("HEAGAWGHEE", "PAWHEAE", 17), ("WWWWWWWW", "WWWWAWWWW", 77), ("X", "X", 4), ("U", "U", 4), ("O", "O", 0), ("J", "J", 4), ("BZ", "BZ", 0), ("", "A", 0)])
def test_goldens(q, d, want):
    assert align.scores(q, [d], parity())[0] == want


residues = st.text("ARNDCQEGHILKMFPSTWYVXUOBZJ-", max_size=24)


@settings(max_examples=60, deadline=None)
@given(residues, st.lists(residues, min_size=1, max_size=5), st.sampled_from([(11, 1), (5, 2), (3, 1), (2, 2), (1, 4)]))
def test_vectorised_equals_naive(q, ds, gaps):
    for m in (parity(), standard()):
        assert align.scores(q, ds, m, *gaps).tolist() == [naive(q, d, m, *gaps) for d in ds]


def test_matrices():
    m, s = parity(), standard()
    assert (m.score("F", "A"), m.score("A", "F"), m.score("B", "B"), m.score("a", "A")) == (-1, -2, -4, -4)
    assert (s.table == s.table.T).all() and s.score("B", "D") == 4 and s.score("W", "W") == 11
    text = "# comment\n   A  R  *\nA  4 -1 -4\nR -1  5 -4\n* -4 -4  1\n"
    assert SubstitutionMatrix.parse(text).score("A", "R") == -1


def test_pairs_nulls_and_long(spark):
    rows = [(1, "ACD", "ACD"), (2, None, "A"), (3, "A" * 1025, "A"), (4, "", "A"), (5, "ACD", "ACD")]
    df = spark.createDataFrame(rows, "id int, query_seq string, db_seq string").withColumn("sw_score", F.lit("old"))
    got = {r.id: r.sw_score for r in align.align_pairs(df).collect()}
    assert got == {1: 19, 2: None, 3: align.TOO_LONG, 4: 0, 5: 19}
    assert align.align_pairs(df.limit(0)).count() == 0
    assert {r.id: r.sw_score for r in align.align_pairs(df, max_length=None).collect()}[3] == 4


def test_all_listed_and_rerank(spark):
    random.seed(2)
    seqs = [(i, "".join(random.choices(A, k=30))) for i in range(12)]
    db = spark.createDataFrame(seqs, "id long, seq string")
    q = db.where("id < 3")
    want = {(a, b): naive(seqs[a][1], seqs[b][1], parity(), 11, 1) for a in range(3) for b in range(12)}
    assert {(r.query_id, r.db_id): r.sw_score for r in align.align_all(q, db).collect()} == want
    assert {(r.query_id, r.db_id): r.sw_score for r in align.align_all(q, db, block_rows=1).collect()} == want
    hits = spark.createDataFrame([(0, 1, 5, 0.9), (0, 2, 0, 0.8), (0, 3, 7, 0.7)], "query_id long, rank int, db_id long, score double")
    got = align.rerank(hits, q, db).orderBy("rank").collect()
    assert got[0].db_id == 0 and [r.sw_score for r in got] == sorted((want[0, d] for d in (5, 0, 7)), reverse=True)


def test_score_expression(spark):
    m = parity()
    got = m.frame(spark).select("a", "b", "score", align.substitution_score(F.col("a"), F.col("b")).alias("x")).where("score <> x")
    assert got.count() == 0
    odd = spark.createDataFrame([("B", "A"), ("", "A"), ("AR", "A")], "a string, b string").select(align.substitution_score(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in odd] == [-4, -4, -4]


def test_blocks_of_queries_give_the_same_scores(spark):
    df = spark.createDataFrame([(i, "ACDEFGHIKLMNPQRSTVWY"[i % 7 : 8 + i]) for i in range(9)], "id long, seq string")
    rows = lambda out: sorted(map(tuple, out.collect()))
    assert rows(align.align_all(df, df, block_rows=2)) == rows(align.align_all(df, df))


def test_many_queries_in_pieces_and_blocks(monkeypatch):
    """Long texts in overlapping pieces, few lanes, antidiagonals in runs, several passes of queries: as the naive programme."""
    draw = random.Random(5)
    some = lambda n: "".join(draw.choice(A + "J-") for _ in range(n))
    for name, value in (("_BODY", 8), ("_CELLS", 40), ("_STEPS", 7), ("_ROWS", 20)):
        monkeypatch.setattr(align, name, value)
    queries = ["", "W", some(12), some(9), some(30)]
    database = ["", some(150), some(40) + queries[4][:20] + queries[4][24:] + some(300), some(1), some(150)] * 2
    cut = [len(align._pieces([d], align._span(align._codes(queries[2]), parity().dense, 11, 1))[0]) for d in database]
    assert max(cut) > 1
    for gaps in ((11, 1), (3, 1), (2, 2), (1, 4), (5, 0)):
        assert align.scores_many(queries, database, parity(), *gaps).tolist() == [[naive(q, d, parity(), *gaps) for d in database] for q in queries]


def test_a_text_is_sent_to_python_once_for_all_queries(spark):
    q = spark.createDataFrame([(1, A), (2, None), (3, ""), (4, A * 60)], "id long, seq string")
    d = spark.createDataFrame([(7, A + A), (8, None), (9, ""), (10, "WW"), (11, A * 60)], "id int, seq string")
    out = align.align_all(q, d)
    assert "NestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
    want = lambda a, b: None if a is None or b is None else align.TOO_LONG if max(len(a), len(b)) > 1024 else naive(a, b, parity(), 11, 1)
    assert sorted((r.query_id, r.db_id, r.sw_score) for r in out.collect()) == [(a.id, b.id, want(a.seq, b.seq)) for a in q.collect() for b in d.collect()]


def test_rerank_finds_its_hits_once(spark, tmp_path):
    """What finds the hits may be an encoder over a whole table: no row of it is computed again."""
    import uuid

    folder = str(tmp_path)

    def found(batches):
        for batch in batches:
            if batch.num_rows:
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield batch

    sequences = spark.createDataFrame([(1, "MKVLAAG"), (2, "MKVLA"), (3, "WWWW"), (4, None)], "id long, seq string")
    hits = spark.createDataFrame([(1, 1, 3, 0.9), (1, 2, 2, 0.8), (1, 3, 1, 0.7)], "query_id long, rank int, db_id long, score double").coalesce(1)
    out = align.rerank(hits.mapInArrow(found, hits.schema), sequences, sequences, max_length=None).orderBy("rank").collect()
    assert [(r.db_id, r.first_rank) for r in out] == [(1, 3), (2, 2), (3, 1)]
    assert len(list(tmp_path.iterdir())) == 1
