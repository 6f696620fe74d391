"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import materialize, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step. ``edges`` holds each link once as (u, v) with u > v.

    The minimum is a pre-aggregated groupBy, written, and goes back to the links by an equi-join of two plain shuffles,
    so that adaptive execution can split a hub's links over tasks; no neighbour list is ever gathered."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialize(around.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m")))
    met = around.join(least, around["u"] == least["c"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has a link; ``component`` is the smallest node reachable.

    ``edges`` has two long columns; nulls, loops and repeats are ignored. Alternates large-star and small-star until
    nothing changes, which takes about log2(longest path) rounds; each round is written to the shared folder, as a table
    and not as a checkpoint, since a checkpoint hands on what the optimizer has inferred, which grows from round to round."""
    a, b = edges.columns[:2]
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = stored(_star(_star(links, large=True), large=False))
        now = state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
