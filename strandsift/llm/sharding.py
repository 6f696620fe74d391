"""Placement by a hierarchical weighted hash tree, in native expressions.

A tree of regions, racks and shards has weights at its leaves; a node weighs what its leaves weigh. A key descends:
at each level every child draws -ln(u) / weight with u from a hash of the key and the child's name, and the smallest
draw wins (weighted rendezvous). A child's draw depends on nothing but the key, its name and its weight, so that when
weights change inside one subtree, keys move only between that subtree and the rest, never among the others; a new
subtree takes keys only into itself. Growing by one shard therefore adds a region of its own.

Slots are numbered without a sort of a whole shard in one task: rows are numbered within (input partition, shard) and
offset by the counts of earlier partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandsift.llm.common import materialize, small

#: name -> subtree, or name -> (shard number, weight) at a leaf
Tree = dict


def regular_tree(regions: int = 3, racks: int = 2, shards: int = 4) -> Tree:
    """``regions * racks * shards`` shards of weight 1, numbered from 0."""
    return {f"region{r}": {f"rack{k}": {f"shard{s}": ((r * racks + k) * shards + s, 1.0) for s in range(shards)} for k in range(racks)} for r in range(regions)}


def grown(tree: Tree) -> Tree:
    """``tree`` with one more shard, in a region of its own."""
    n = sum(1 for _ in leaves(tree))
    return {**tree, f"region{len(tree)}": {"rack0": {"shard0": (n, 1.0)}}}


def leaves(tree: Tree):
    for child in tree.values():
        if isinstance(child, dict):
            yield from leaves(child)
        else:
            yield child


def weight(node) -> float:
    return sum(w for _, w in leaves(node)) if isinstance(node, dict) else node[1]


def draw(key: Column, name: str, of: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 53 bits of the hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(u) / F.lit(float(of))


def place(key: Column, tree: Tree, path: str = "") -> Column:
    """The shard number of ``key`` in ``tree``. Only the draws along the chosen path are made."""
    children = [(name, child) for name, child in tree.items() if weight(child) > 0]
    if len(children) == 1:
        inner = [children[0]]
        chosen = None
    else:
        draws = [F.struct(draw(key, f"{path}/{name}", weight(child)).alias("draw"), F.lit(i).alias("child")) for i, (name, child) in enumerate(children)]
        chosen, inner = F.least(*draws)["child"], children
    below = [place(key, child, f"{path}/{name}") if isinstance(child, dict) else F.lit(child[0]) for name, child in inner]
    if chosen is None:
        return below[0]
    return F.get(F.transform(F.array(chosen), lambda c: F.coalesce(*[F.when(c == i, b) for i, b in enumerate(below)])), F.lit(0))


def assign(docs: DataFrame, tree: Tree | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id column, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    The id and the tree alone decide the shard (law 'key'). size: UTF-8 bytes of the text plus 8; a null text has none
    and counts as empty. Null ids are a key like any other; equal ids share a shard, each row with its own slot; an
    empty table gives an empty result; other columns are ignored."""
    tree = regular_tree() if tree is None else tree
    key, text = F.col(id_column), F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(key.alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place(key, tree).cast("int").alias("shard"), place(key, grown(tree)).cast("int").alias("grown_shard"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows)
    counts = rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.withColumn("before", F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).select("part", "shard", "before")
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("part", "shard").orderBy("row")) - 1)
    placed = own.join(small(materialize(before)), ["part", "shard"])
    return placed.select(F.col("id").alias(id_column), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"), "grown_shard")
