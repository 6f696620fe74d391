import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandsift.llm import similar, simhash
from strandsift.llm.bktree import Forest, Union
from strandsift.llm.components import connected_components


def stated_fingerprint(text, k=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", w)]
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    ids = list(prints)
    to = {i: i for i in ids}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = root(a), root(b)
                to[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_query_equals_brute_force(spark, small, texts):
    from strandsift.llm import queries

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, small).collect()}
    prints = {i: stated_fingerprint(t) for i, t in texts.items()}
    comp = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in prints}


@pytest.mark.parametrize("shard_rows", [4096, 40, 8])
def test_hot_shards_lose_no_link(spark, shard_rows):
    """A dense ball of fingerprints shares its bands: the finer bands and the stripes must find every link."""
    random.seed(shard_rows)
    centre = random.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in random.sample(range(64), random.randrange(7))) for _ in range(250)} | {random.getrandbits(64) for _ in range(150)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    got = {r.node: r.component for r in connected_components(simhash.links(df, 4, shard_rows)).collect()}
    want = brute_components({s: s & (2**64 - 1) for s in sorted(signed)})
    # the smallest member names a component
    assert {p: got.get(p, p) for p in signed} == want


def test_forest_equals_brute_force():
    draw = np.random.default_rng(4)
    shard = np.sort(draw.integers(0, 5, 300))
    base = draw.integers(0, 2**63, 8, dtype=np.uint64)
    prints = np.array([int(base[draw.integers(8)]) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 9), replace=False)) for _ in range(300)], np.uint64)
    keep = np.array([i for i in range(300) if not any(shard[i] == shard[j] and prints[i] == prints[j] for j in range(i))])
    shard, prints = shard[keep], prints[keep]
    for radius in (0, 4, 15, 64):
        found = {(int(i), int(j)): int(d) for part in Forest(shard, prints[:, None]).search(radius, budget=500) for i, j, d in zip(*part, strict=True)}
        want = {(i, j): int(np.bitwise_count(prints[i] ^ prints[j])) for i in range(len(prints)) for j in range(i) if shard[i] == shard[j]}
        assert found == {k: v for k, v in want.items() if v <= radius}


def test_union_gives_a_spanning_forest():
    u = Union(6)
    used = u.link(np.array([1, 2, 2, 5]), np.array([0, 1, 0, 4]))
    assert u.to.tolist() == [0, 0, 0, 3, 4, 4] and len(used) == 3


def test_components_of_a_long_path(spark):
    n = 300
    order = random.Random(3).sample(range(n), n)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(7, 7), (None, 1), (1000, 1001), (1001, 1000)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}
    assert connected_components(edges.limit(0)).count() == 0


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and simhash.near_duplicates(empty).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (1, 2) for r in by[i]} == {1} and len(by[2]) == 2
    assert {r.component_id for i in (3, 4, 5) for r in by[i]} == {3} and by[3][0].fingerprint == "0" * 16
    assert {r.component_id for r in by[None]} == {3, None}


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = t.encode().lower().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    x, y = sets
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_groups_equal_brute_force(spark):
    """Edited copies of long texts, up to a similarity just under and over the threshold."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = draw.choices(words, k=300)
        for edits in (0, 0, 1, 2, 4, 6, 9, 40):
            own = list(base)
            for p in draw.sample(range(300), edits):
                own[p] = draw.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.node: r.component for r in similar.similar_groups(df).collect()}
    to = list(range(n))
    for a in range(n):
        for b in range(a):
            if jaccard(rows[a][1], rows[b][1]) >= 0.8:
                x, y = to[a], to[b]
                to = [min(x, y) if t in (x, y) else t for t in to]
    assert [got.get(i, i) for i in range(n)] == to
    assert {r.doc_id for r in similar.drop_near_duplicates(df).collect()} == {i for i in range(n) if to[i] == i}


@pytest.mark.parametrize("shard_rows", [4096, 16])
def test_similar_groups_in_hot_shards(spark, shard_rows):
    draw = random.Random(6)
    base = [f"w{draw.randrange(999)}" for _ in range(400)]
    rows = []
    for i in range(120):
        own = list(base)
        own[draw.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r.node: r.component for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=shard_rows).collect()}
    assert got == dict.fromkeys(range(120), 0)


def test_drop_odd_rows(odd, empty):
    kept = similar.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and similar.drop_near_duplicates(empty).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8] and ids.count(None) == 2


def brute_similar(texts, similarity=0.8):
    to = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if to[a] != to[b] and jaccard(texts[a], texts[b]) >= similarity:
                x, y = to[a], to[b]
                to = [min(x, y) if t in (x, y) else t for t in to]
    return to


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_large_groups_lose_no_pair(spark, shard_rows):
    """A dense ball whose members are partly just over and partly just under the threshold from each other."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(160):
        own = list(base)
        for p in draw.sample(range(120), draw.choice((1, 2, 2, 3, 3, 4))):
            own[p] = f"x{i}p{p}"
        texts.append(" ".join(own))
    want = brute_similar(texts)
    assert 1 < len(set(want)) < 120
    got = {r.node: r.component for r in similar.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard_rows=shard_rows).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_short_texts_lose_no_pair(spark):
    """Texts of 8 and 9 words have 4 and 5 shingles and a similarity of exactly 0.8."""
    draw = random.Random(9)
    texts = []
    for _ in range(400):
        own = [f"w{draw.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(own[:8]), " ".join(own)]
    got = {r.node: r.component for r in similar.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(800)] == [i // 2 * 2 for i in range(800)]


def test_drop_is_by_row(spark):
    """Rows that share an id, or have none, are judged each by its own text."""
    copy, other, third = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, copy), (2, copy), (2, other), (3, third), (3, third), (None, copy), (None, "d e f g h i j"), (None, "d e f g h i j")]
    got = similar.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(got, key=str) == sorted([(1, copy), (2, other), (3, third), (None, "d e f g h i j")], key=str)


def matrix_components(texts, similarity=0.8, k=5):
    """Components over all pairs, from counts of shared shingles as a product of matrices."""
    sets = [{tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in texts]
    place = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(texts), len(place)), np.float32)
    for i, own in enumerate(sets):
        m[i, [place[s] for s in own]] = 1
    shared, size = np.rint(m @ m.T), m.sum(1)
    to = list(range(len(texts)))
    for a, b in zip(*np.nonzero(shared + 1e-6 >= similarity * (size[:, None] + size - shared)), strict=True):
        while to[a] != a:
            a = to[a]
        while to[b] != b:
            b = to[b]
        to[max(a, b)] = min(a, b)
    for i in range(len(to)):
        to[i] = to[to[i]]
    return to


def test_groups_near_the_threshold_equal_all_pairs(spark):
    """Copies of a text of 300 words, four words of each changed at random: about one pair in twenty is similar."""
    draw = random.Random(12)
    texts, want = [], []
    for group, copies in enumerate((60, 400, 1000)):
        base, own = [f"g{group}w{i}" for i in range(300)], []
        for i in range(copies):
            words = list(base)
            for p in draw.sample(range(300), 4):
                words[p] = f"g{group}x{i}p{p}"
            own.append(" ".join(words))
        want += [x + len(texts) for x in matrix_components(own)]
        texts += own
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.node: r.component for r in similar.similar_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < 40


@pytest.mark.parametrize(("few", "shard_rows"), [(32, 4096), (4, 4096), (4, 24)])
def test_shared_passages_lose_no_pair(spark, few, shard_rows):
    """Texts made of passages that many others hold, so that most of what a pair shares is crowded."""
    draw = random.Random(13)
    passages = [[f"p{k}w{i}" for i in range(draw.randrange(20, 90))] for k in range(12)]
    texts = []
    for i in range(300):
        words = [w for k in draw.sample(range(12), draw.choice((1, 2, 3))) for w in passages[k]]
        texts.append(" ".join(words + [f"u{i}v{j}" for j in range(draw.choice((0, 1, 3, 10, 40)))]))
    want = matrix_components(texts)
    assert 20 < len(set(want)) < 280
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id string, text string").repartition(3)
    got = {int(r.node): r.component for r in similar.similar_groups(df, few=few, shard_rows=shard_rows).collect()}
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, set()).add(i)
    brute = {}
    for i, c in enumerate(want):
        brute.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))
    assert all(c == min(map(str, g)) for c, g in groups.items())


def test_clashing_columns(spark, tmp_path):
    """Columns with the names that the operator uses, read from files and not."""
    texts = [" ".join(f"w{i % 7}x{j}" for j in range(40)) for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("row", "file", "index", "id", "n", "tokens", "component", "p", "token"):
        df = df.withColumn(name, F.lit(name))
    df.write.parquet(f"{tmp_path}/t")
    for docs in (df, spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/t").withColumn("_metadata", F.lit(1))):
        kept = similar.drop_near_duplicates(docs)
        assert kept.columns == docs.columns and {(r.doc_id, r.row, r.tokens) for r in kept.collect()} == {(i, "row", "tokens") for i in range(7)}


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9, 1.0])
def test_similar_sizes_share_a_band(spark, similarity):
    """Sizes that can be similar are in the same or in neighbouring bands."""
    n = 700
    band = [r.b for r in spark.range(1, n).select(similar._size_band(F.col("id"), similarity).alias("b")).collect()]
    for a in range(1, n):
        for b in range(a, min(n, int((a + 1e-9) / similarity) + 1)):
            assert 0 <= band[b - 1] - band[a - 1] <= 1


def test_a_family_of_many_sizes_meets_by_bands(spark, monkeypatch):
    """Texts of many sizes around one passage, hardly any of them near-duplicates: bands of size send a third fewer sets, and
    the groups are those of all pairs."""
    draw = random.Random(14)
    passage = [f"p{j}" for j in range(40)]
    texts = [" ".join(passage + [f"u{i}v{j}" for j in range(int(1.01**i) + draw.randrange(3))]) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sent = []
    forests = similar._forests
    monkeypatch.setattr(similar, "_forests", lambda shards, s: (sent.append(shards.count()), forests(shards, s))[1])
    run = lambda: {r.node: r.component for r in similar.similar_groups(df, shard_rows=20, few=4, sample_docs=1).collect()}
    got, banded = run(), sent[-1]
    assert [got[i] for i in range(500)] == matrix_components(texts)
    monkeypatch.setattr(similar, "_size_band", lambda n, *rest: F.lit(0))
    assert run() == got
    assert banded < 0.75 * sent[-1]


def test_no_sets_of_pairs_that_share_too_little(spark, monkeypatch):
    """Texts that share most of a prefix, yet too little in all, are told by the counts of their parts: their sets are not made."""
    draw = random.Random(15)
    texts = []
    for group in range(30):
        base = [f"g{group}w{i}" for i in range(400)]
        for i, first in enumerate((20, 150, 300)):
            texts.append(" ".join(base[:first] + [f"g{group}c{i}x{j}" for j in range(35)] + base[first + 35 :]))
        texts.append(texts[-1] + f" end{draw.random()}")
    want = matrix_components(texts)
    made, sets = [], similar._sets
    monkeypatch.setattr(similar, "_sets", lambda keyed, sketches, wanted, *rest: (made.append(wanted.count()), sets(keyed, sketches, wanted, *rest))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.node: r.component for r in similar.similar_groups(df).collect()}
    assert [got[i] for i in range(120)] == want and len(set(want)) == 90
    assert 60 <= made[0] < 75


def test_the_bound_on_shared_shingles():
    """Counts of parts never give less than what two sets share."""
    draw = np.random.default_rng(16)
    for n in (0, 1, 5, 63, 64, 300, 2000, 30_000):
        for share in (0.0, 0.5, 0.9, 1.0):
            every = np.unique(draw.integers(0, 1 << 63, 3 * n + 8).astype(np.uint64))
            k = int(share * n)
            a, b = every[:n], np.concatenate([every[:k], every[n : n + int(1.2 * n) - k]])
            assert similar._most_shared(similar._part_counts(a), similar._part_counts(b)) >= k
    same = np.arange(0, 300 * 256, 256).astype(np.uint64)  # all in one part
    assert similar._most_shared(similar._part_counts(same), similar._part_counts(same)) >= 300


@pytest.mark.parametrize("tokens", [0, 1_000_000])
def test_texts_are_not_shuffled(spark, monkeypatch, tmp_path, tokens):
    """However many rows and tokens there are: what is dropped is sent as bits."""
    monkeypatch.setattr(similar, "small", lambda df, rows=0: df)
    monkeypatch.setattr(similar, "_TOKENS", tokens)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, -1)
        texts = [" ".join(f"w{i % 70}x{j}" for j in range(40)) for i in range(300)]
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
        kept = similar.drop_near_duplicates(spark.read.parquet(f"{tmp_path}/t"))
        assert sorted(r.doc_id for r in kept.collect()) == list(range(70))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set(key, before)
