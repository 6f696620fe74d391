"""SimHash near-duplicate detection with sharded BK-trees.

1. Fingerprints: 64-bit SimHash of word shingles, one pass over the texts in Arrow batches.
2. Equal fingerprints fold to one row, by a pre-aggregated groupBy, so that copies never meet in one group.
3. Shards. Two fingerprints with at most ``radius`` differing bits agree wholly in one of ``radius + 1`` bands
   (pigeonhole), so each band's value names a shard and no link is lost. A shard of more than ``shard_rows`` rows is
   dealt anew by the bands of its remaining bits; one that is still too large (a dense ball of near copies) is cut
   into stripes, and each two stripes meet in one shard. Every shard's tree has a proven bound on its size.
4. Each task builds the trees of its shards and follows only edges within the radius. It returns a spanning forest of
   what it found, at most one row for each fingerprint and shard, never the pairs of a group.
5. Components by alternating stars over those links.

The trees go to the tasks by a shuffle on the shard, not as a broadcast of every tree to every task: what one task
needs is bounded, while all trees together grow with the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandsift.llm.bktree import Forest, Union
from strandsift.llm.common import encoded, materialize
from strandsift.llm.components import connected_components

SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The XXH64 of each of the ``words``-word shingles of a UTF-8 text, repeats included; of the whole sequence if it
    has fewer words; nothing of a text without words. A-Z are lower-cased; words are runs of anything but ASCII white
    space."""
    tokens = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), SEED)] if tokens else [], np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(tokens) - words + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the ``words``-word shingles of a UTF-8 text, repeats included; 0 for a text without words. A bit is
    set if more than half of the shingles' XXH64 have it."""
    return majority(shingle_hashes(text, words))


def _counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``."""
    return int(np.packbits(_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4) -> DataFrame:
    """(id, fingerprint as signed long) for every row; a null text counts as empty."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x, words) for x in encoded(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, print long")


def _bands(bits: range, count: int) -> list[list[int]]:
    """``bits`` dealt into ``count`` runs of nearly equal length."""
    every = list(bits)
    cuts = [len(every) * k // count for k in range(count + 1)]
    return [every[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _value(bits: list[int], column: str = "print") -> Column:
    mask = sum(1 << b for b in bits)
    return F.col(column).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _shards(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(shard, print): each two fingerprints within ``radius`` share a shard; none holds over about ``shard_rows``."""
    bands = _bands(range(64), radius + 1)
    rows = prints.select("print", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), _value(b)).alias("shard")) for k, b in enumerate(bands)])).alias("x")).select("print", "x.band", "x.shard")

    def hot(df: DataFrame) -> DataFrame:
        return materialize(df.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > shard_rows))

    large = hot(rows)
    fine = rows.join(large, "shard", "left_anti").select("shard", "print")
    if not large.isEmpty():
        rest = [_bands([b for b in range(64) if b not in taken], radius + 1) for taken in bands]
        again = [F.array(*[F.xxhash64("shard", F.lit(j), _value(b)) for j, b in enumerate(part)]) for part in rest]
        chosen = F.coalesce(*[F.when(F.col("band") == k, x) for k, x in enumerate(again)])
        second = rows.join(large.select("shard"), "shard", "left_semi").select("print", F.explode(chosen).alias("shard"))
        larger = hot(second)
        fine = fine.unionByName(second.join(larger, "shard", "left_anti").select("shard", "print"))
        if not larger.isEmpty():
            striped = second.join(larger, "shard").withColumn("stripes", F.ceil(F.col("rows") * 2 / F.lit(shard_rows)).cast("int"))
            striped = striped.withColumn("own", F.pmod(F.xxhash64("print"), F.col("stripes")).cast("int"))
            meets = F.transform(F.sequence(F.lit(0), F.col("stripes") - 1), lambda t: F.xxhash64(F.col("shard"), F.least(F.col("own"), t), F.greatest(F.col("own"), t)))
            fine = fine.unionByName(striped.select("print", F.explode(meets).alias("shard")).select("shard", "print"))
    return fine


def links(prints: DataFrame, radius: int, shard_rows: int = 4096) -> DataFrame:
    """(a, b) of distinct fingerprints, a spanning forest of those within ``radius`` for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(shard: np.ndarray, own: np.ndarray):
            forest, union = Forest(shard, own[:, None]), Union(len(own))
            for i, j, _ in forest.search(radius):
                union.link(i, j)
            moved = np.flatnonzero(union.to != np.arange(len(own)))
            return pa.RecordBatch.from_arrays([pa.array(own[moved].view(np.int64)), pa.array(own[union.to[moved]].view(np.int64))], names=["a", "b"])

        shard, own = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            shard = np.r_[shard, batch.column(0).to_numpy(zero_copy_only=False)]
            own = np.r_[own, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if len(shard) >= 100_000 and shard[0] != shard[-1]:
                cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
                yield found(shard[:cut], own[:cut])
                shard, own = shard[cut:], own[cut:]
        if len(shard):
            yield found(shard, own)

    shards = _shards(prints, radius, shard_rows)
    return shards.repartition("shard").sortWithinPartitions("shard", "print").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """(id column, fingerprint, component_id, is_copy) for every row of ``docs``.

    fingerprint: 16 lowercase hex digits. component_id: the smallest id reachable by links of at most ``radius``
    differing bits, the row itself included. is_copy: another row has the same fingerprint.

    Null ids stay rows and never name a component that has another id; null and empty texts have fingerprint zero and
    are linked like any other; rows that repeat each get a row; an empty table gives an empty result; other columns
    are ignored. Other columns of ``docs`` may have any name."""
    prints = materialize(fingerprints(docs, id_column, text_column, words))
    distinct = materialize(prints.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
    component = connected_components(links(distinct.select("print"), radius, shard_rows))
    named = materialize(distinct.join(component.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print")))
    # both sides are written, so that the joins have two plain shuffles each and a print or component of many rows can be split
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")))
    named = materialize(named.join(least, "component").select("print", "component_id", "rows"))
    return prints.join(named, "print").select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", (F.col("rows") > 1).alias("is_copy"))
