import math
import re
import struct
import zlib
from collections import Counter

import xxhash

from strandsift.llm import queries, sharding


def test_query(spark, small, texts):
    df = queries.op7_sharding(spark, small)
    got = df.collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    for shard in range(24):
        own = [r.slot for r in got if r.shard == shard]
        assert sorted(own) == list(range(len(own)))
    assert {r.law for r in got} == {"key"} and all(r.grown_shard in (r.shard, 24) for r in got)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_only_the_key_decides(spark):
    a = spark.range(20_000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    b = spark.range(20_000).selectExpr("19999 - id AS doc_id", "'other' AS text").repartition(7)
    one, two = ({r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(x).collect()} for x in (a, b))
    assert one == two
    n = Counter(s for s, _ in one.values())
    assert len(n) == 24 and max(n.values()) < 1.2 * 20_000 / 24 and min(n.values()) > 0.8 * 20_000 / 24
    moved = [g for s, g in one.values() if s != g]
    assert set(moved) == {24} and 0.8 / 25 < len(moved) / 20_000 < 1.2 / 25


def test_weights_confine_movement(spark):
    """A heavier shard draws keys into its region; keys of other regions move only into that region."""
    df = spark.range(20_000).withColumnRenamed("id", "key")
    tree = sharding.regular_tree()
    heavier = {**tree, "region1": {**tree["region1"], "rack0": {**tree["region1"]["rack0"], "shard0": (8, 4.0)}}}
    rows = df.select(sharding.place(df["key"], tree).alias("a"), sharding.place(df["key"], heavier).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(8 <= b < 16 for _, b in moved)
    share = sum(r.b == 8 for r in rows) / len(rows)
    assert abs(share - 4 / 27) < 0.02


def test_weight_zero_takes_nothing(spark):
    df = spark.range(2000).withColumnRenamed("id", "key")
    tree = {"a": {"x": {"s": (0, 1.0), "t": (1, 0.0)}}, "b": {"y": {"s": (2, 0.0)}}}
    assert {r[0] for r in df.select(sharding.place(df["key"], tree)).collect()} == {0}


def test_odd_rows(odd, empty):
    got = sharding.assign(odd).collect()
    assert len(got) == odd.count() and sharding.assign(empty).count() == 0
    assert {r["size"] for r in got if r.doc_id in (3, 4)} == {8}
    for shard in {r.shard for r in got}:
        own = [r.slot for r in got if r.shard == shard]
        assert sorted(own) == list(range(len(own)))
    assert len({r.shard for r in got if r.doc_id == 2}) == 1


def stated_shard(key, tree, path=""):
    """The descent by draws, written out: XXH64 of the key's eight bytes, then of the child's path, seeded by the former."""
    best = None
    for name, child in tree.items():
        leaf = not isinstance(child, dict)
        weight = child[1] if leaf else sum(w for _, w in sharding.leaves(child))
        h = xxhash.xxh64_intdigest(f"{path}/{name}".encode(), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
        draw = -math.log(((h >> 11) + 0.5) / 2**53) / weight
        if best is None or draw < best[0]:
            best = (draw, name, child)
    _, name, child = best
    return stated_shard(key, child, f"{path}/{name}") if isinstance(child, dict) else child[0]


def test_draws_equal_the_stated_descent(spark):
    uneven = {"a": {"x": {"s": (0, 1.0), "t": (1, 2.5)}, "y": {"s": (2, 0.5), "t": (3, 1.0)}}, "b": {"x": {"s": (4, 4.0), "t": (5, 1.0)}, "y": {"s": (6, 1.0), "t": (7, 3.0)}}}
    keys = [*range(2000), -1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long").selectExpr("doc_id", "'' AS text")
    for tree in (sharding.regular_tree(), uneven):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(df, tree).collect()}
        assert got == {k: (stated_shard(k, tree), stated_shard(k, sharding.grown(tree))) for k in keys}
