import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsift.functions.substitution import parity, standard
from strandsift.operators import align, tiles, trace
from test_align import naive

LETTERS = "ARNDCQEGHILKMFPSTWYVXUOBZJ-"


def some(rnd, n, letters=LETTERS):
    return "".join(rnd.choice(letters) for _ in range(n))


def near(rnd, s):
    """``s`` with letters lost, changed and put in."""
    return "".join(rnd.choice([c, c, c, c, c, c, "", c + rnd.choice(LETTERS), rnd.choice(LETTERS)]) for c in s)


def first_end(q, d, m, go, ge):
    """(score, row, column) by the plain programme."""
    ge = min(go, ge)
    h = np.zeros((len(q) + 1, len(d) + 1), int)
    e, f = np.full(h.shape, -10000), np.full(h.shape, -10000)
    best = (0, None, None)
    for i in range(1, len(q) + 1):
        for j in range(1, len(d) + 1):
            e[i, j] = max(e[i - 1, j] - ge, h[i - 1, j] - go)
            f[i, j] = max(f[i, j - 1] - ge, h[i, j - 1] - go)
            h[i, j] = max(0, h[i - 1, j - 1] + m.score(q[i - 1], d[j - 1]), e[i, j], f[i, j])
            if h[i, j] > best[0]:
                best = (int(h[i, j]), i - 1, j - 1)
    return best


@pytest.mark.parametrize(("gap_open", "gap_extend", "size"), [(11, 1, 16), (3, 1, 9), (2, 4, 21)])
def test_tiles_equal_the_plain_programme(spark, gap_open, gap_extend, size):
    rnd = random.Random(size)
    q = [some(rnd, rnd.randrange(1, 45), rnd.choice([LETTERS, "ARN"])) for _ in range(6)] + ["", None, "WW"]
    d = [near(rnd, q[i % 6]) for i in range(6)] + ["", None, some(rnd, 60)]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, seq string")
    pairs = [(i, j) for i in range(9) for j in range(9) if (i + j) % 2] + [(0, 1), (0, 99), (None, 1)]
    got = tiles.align_tiled(spark.createDataFrame(pairs, "query_id long, db_id long"), frame(q), frame(d), standard(), gap_open, gap_extend, size).collect()
    want = {(i, j): first_end(q[i], d[j], standard(), gap_open, gap_extend) for i, j in pairs if i is not None and j < 9 and q[i] and d[j]}
    assert len(got) == len(want)
    assert {(r.query_id, r.db_id): (r.sw_score, r.query_end, r.db_end) for r in got} == want


def test_no_long_pair_at_all(spark):
    none = spark.createDataFrame([], "query_id long, db_id long")
    seqs = spark.createDataFrame([(1, "ACD")], "id long, seq string")
    assert tiles.align_tiled(none, seqs, seqs).count() == 0


def test_listed_and_all_pairs_take_tiles_beyond_a_length(spark):
    rnd = random.Random(4)
    q = [some(rnd, n) for n in (5, 90, 20)] + [None, ""]
    d = [near(rnd, q[1]), some(rnd, 12), near(rnd, q[2]), None, ""]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, seq string")
    want = {(i, j): None if a is None or b is None else naive(a, b, parity(), 11, 1) for i, a in enumerate(q) for j, b in enumerate(d)}
    as_dict = lambda df: {(r.query_id, r.db_id): r.sw_score for r in df.collect()}
    everything = align.align_all(frame(q), frame(d), long=30, max_length=None)
    assert everything.count() == len(want) and as_dict(everything) == want
    pairs = spark.createDataFrame(list(want), "query_id long, db_id long")
    listed = align.align_listed(pairs, frame(q), frame(d), long=30, max_length=None)
    assert listed.count() == len(want) and as_dict(listed) == want


def test_memory_of_a_tile_does_not_grow_with_the_sequences(spark):
    """Two sequences of 20,000 letters, whose table would hold 400 million cells, against a plain sweep over rows."""
    rnd = random.Random(9)
    q = some(rnd, 20_000, "ACDEFGHIKLMNPQRSTVWY")
    d = some(rnd, 500) + near(rnd, q[3000:17_000]) + some(rnd, 800)
    frame = lambda s: spark.createDataFrame([(1, s)], "id long, seq string")
    got = tiles.align_tiled(spark.createDataFrame([(1, 1)], "query_id long, db_id long"), frame(q), frame(d), size=4096).first()
    assert got.sw_score == align.scores(q, [d], parity())[0]


def worth(q, d, found, m, go, ge):
    total = 0
    for (op, a, b, c, e), after in zip(found, [*found[1:], None], strict=False):
        total += sum(m.score(x, y) for x, y in zip(q[a:b], d[c:e], strict=True)) if op == "M" else -(go + (max(b - a, e - c) - 1) * min(go, ge))
        assert (b > a) == (op != "D") and (e > c) == (op != "I")
        assert after is None or (after[1], after[3]) == (b, e) and after[0] != op
    return total


def test_spans_are_worth_the_score_however_small_the_tables():
    rnd = random.Random(1)
    for _ in range(600):
        m, (go, ge) = rnd.choice([parity(), standard()]), rnd.choice([(11, 1), (5, 2), (3, 1), (2, 2), (1, 4), (4, 0)])
        q = some(rnd, rnd.randrange(40), rnd.choice([LETTERS, "AR"]))
        d = rnd.choice([some(rnd, rnd.randrange(40)), near(rnd, q)])
        score, found = trace.spans(q, d, m, go, ge, cells=rnd.choice([1, 6, 30, 1000]))
        assert score == naive(q, d, m, go, ge) == worth(q, d, found, m, go, ge)


def test_trace_as_a_table_function(spark):
    q, d = "HEAGAWGHEE", "PAWHEAE"
    frame = lambda rows: spark.createDataFrame(rows, "id long, seq string")
    queries, database = frame([(1, q), (2, ""), (3, None), (4, "W")]), frame([(1, d), (2, d), (3, "A")])
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (4, 3), (9, 1), (1, 1)], "query_id long, db_id long")
    got = align.align_listed(pairs, queries, database).join(trace.rescored(trace.align_trace(pairs.distinct(), queries, database), queries, database).withColumnRenamed("sw_score", "again"), ["query_id", "db_id"])
    assert {(r.query_id, r.db_id, r.sw_score, r.again) for r in got.collect()} == {(1, 1, 17, 17), (1, 2, 17, 17)}
    rows = trace.align_trace(pairs, queries, database).where("db_id = 1").orderBy("step").collect()
    own = [tuple(r)[3:] for r in rows]
    assert own[::2] == own[1::2]  # the repeated pair
    assert worth(q, d, own[::2], parity(), 11, 1) == 17
    assert trace.align_trace(pairs.limit(0), queries, database).count() == 0
    assert trace.align_trace(pairs, queries, database).select(F.min("query_begin")).first()[0] >= 0
