import hashlib
import re

import pytest
from pyspark.sql import functions as F

from strandsift.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """docs, items: (id, text) pairs -> {id: (n_words, n_hit, item ids)}"""
    found = {}
    for d, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for i, t in items:
            v = words(t)
            if not v or i is None:
                continue
            n = min(window, len(v))
            for k in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p] == v[k] and w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(i))
        found[d] = (len(w), len(hit), sorted(ids))
    return found


def test_query_equals_brute_force(spark, small, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = brute(texts.items(), items)
    got = queries.op4_decontamination(spark, small).collect()
    assert len(got) == len(texts) and any(r.contaminated for r in got)
    for r in got:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


DOCS = [(1, "x A b-c d E f g h I j k y"), (2, "a b c d e f g h i"), (3, "short one here, SHORT one"), (4, "a a a a a a a a a a a a"), (5, None), (6, ""), (7, "b c d e f g h i j k l b c d e f g h i j k l"), (8, "éa éb ec short"), (8, "éa éb ec short")]
ITEMS = [(10, "a b c d e f g h i j k"), (2, "short one"), (3, "a a a a a a a a a a"), (4, None), (5, "?!"), (6, "ÉA"), (7, "éa"), (7, "b c d e f g h i j k l m"), (None, "short"), (11, "one")]


@pytest.mark.parametrize("block_windows", [200_000, 2])
def test_edges_and_blocks(spark, block_windows):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("spans", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, items, block_windows=block_windows).collect()
    want = brute(DOCS, ITEMS)
    assert len(got) == len(DOCS)
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"])) == want[r.doc_id]
        assert sum(s.end - s.first for s in r.hit_spans) == r.n_hit
    kept = decontaminate.drop_contaminated(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in DOCS if not want[d][1]) and kept.columns == docs.columns


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    got = decontaminate.contamination(odd, items).collect()
    assert len(got) == odd.count() and sum(r.n_hit for r in got) == 30
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(odd, items).count() == odd.count() - 3


@pytest.mark.parametrize("block_windows", [200_000, 2])
def test_clashing_names(spark, block_windows):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    for name in ("contamination", "_contamination", "file", "index", "row", "found"):
        docs = docs.withColumn(name, F.lit(name))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r._contamination for r in kept.collect()} == {"_contamination"}
    marked = decontaminate.mark(docs, items, block_windows=block_windows, output="hits")
    assert marked.columns == [*docs.columns, "hits"]
    assert sorted((r.doc_id, len(r.hits["spans"]) > 0) for r in marked.collect()) == sorted((d, n > 0) for d, (_, n, _) in [(d, brute(DOCS, ITEMS)[d]) for d, _ in DOCS])
