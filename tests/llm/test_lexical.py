import math
import random
import re
from collections import Counter

import pytest

from strandsift.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, k):
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    by = {}
    for i, t in items:
        by.setdefault(i, Counter()).update(words(t))
    out = []
    for i, own in by.items():
        found = []
        for d, tf, n in held:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, x in own.items() if t in tf)
            if s > 0:
                found.append((-s, d is None, d if d is not None else 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("block_terms", [500_000, 15])
def test_against_brute_force(spark, block_terms):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Äß", "é1", "W3"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)) + rnd.choice(["", ".", "-W1_w2"])
    docs = [(i, text(rnd.randrange(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(50)]  # ties
    docs += [(7, docs[9][1]), (7, docs[9][1]), (None, docs[5][1]), (None, None), (400, None), (401, ""), (402, " ._- "), (403, "w1 " * 5000)]
    items = [(i, text(rnd.randrange(1, 12))) for i in range(20)] + [(3, "w1 w1 w2"), (None, "w5 w6"), (50, ""), (51, None), (52, "nowhere"), (53, "w1 w1 w1")]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, score int").repartition(5)
    got = lexical.rank(df, spark.createDataFrame([(*r, 9, "x") for r in items], "item_id long, text string, doc int, term string"), 10, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(map(tuple, got.collect())) == key(brute(docs, items, 10))


def test_ids_of_other_types(spark):
    docs = [("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "x z z")]
    items = [("i", "x z"), ("j", "y")]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), 3)
    assert [(r.item_id, r["rank"], r.doc_id) for r in got.orderBy("item_id", "rank").collect()] == [("i", 1, "c"), ("i", 2, "a"), ("i", 3, "b"), ("j", 1, "a"), ("j", 2, "b"), ("j", 3, None)]


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    for d, i in ((documents.limit(0), items), (documents, items.limit(0)), (documents, items.select("item_id").selectExpr("item_id", "'' text"))):
        got = lexical.rank(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert got.count() == 0


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "ONE two nul emoji"), (2, "word5x5 ééé")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert key(map(tuple, lexical.rank(odd, items).collect())) == key(brute(docs, [(r.item_id, r.text) for r in items.collect()], 20))


def test_best_keeps_ties_by_id_over_blocks():
    import numpy as np
    import pyarrow as pa

    best = lexical.Best(1, 3)
    for block in ([9, 8, 7], [3, 2, None], [1, 5, 4]):
        ids = pa.array(block)
        order = np.argsort(np.argsort([x if x is not None else 99 for x in block]))
        best.take(0, np.array([5, 5, 5], np.int64), order, ids)
    assert [(s, d) for s, _, d in best.rows[0]] == [(-5, 1), (-5, 2), (-5, 3)]
