"""Near-duplicates on word shingles: SimHash groups first, then an exact join for what they leave.

A SimHash tells similar texts only with some probability, while here no link may be lost. So:

1. One pass over the texts gives each row the digest of its shingle set, its SimHash and its prefix: the first
   n - ceil(similarity * n) + 1 of its n shingles in a common order, rare before common. Rows of equal sets fold to one
   node.
2. BK-trees over the fingerprints (``simhash.links``) give groups. The sets of a group meet in chunks of bounded size and
   are compared there; where a group has several chunks, one node for each part found meets again, until no chunk joins
   any more. So a ball of near copies, however large, shrinks to few parts, each node being sent once a round.
3. Two similar sets share shingles of both prefixes, the more the nearer their sizes. Shingles of up to ``few`` nodes give
   pairs. A crowded shingle (up to ``shard_rows`` nodes) gives only the pairs that may share no others, as few of a text's
   shingles are crowded and its sizes leave little choice. What sizes and the number of shared shingles rule out goes, as does
   what two sets' counts over parts of all shingles rule out; the rest is verified on the sets. Texts whose prefix is mostly crowded, and shingles of more nodes, are dealt to shards in
   which each node outside the largest part meets every other; the sets are compared there and a forest of verified links
   comes out. Shingles of one and the same largest part share their shards where that sends fewer sets, and sets of sizes
   too far apart never meet where that does.
4. Components over all verified links.

Steps 1, 3 and 4 find every link whatever step 2 did; step 2 decides what they cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandsift.llm import simhash
from strandsift.llm.common import encoded, keyed_rows, marked, materialize, small, stored
from strandsift.llm.components import connected_components

#: Shingles that a task holds at a time, about.
_VALUES = 1_000_000
#: Parts of all shingles at most, of which each set's are counted.
_MOST_PARTS = 8192
#: Tokens that are sent to every task at most; of more, one bit each is.
_TOKENS = 1_000_000


def _text(text_column: str) -> Column:
    return F.col("row")[text_column].cast("string").alias("text")


def _least_shared(size: int, similarity: float) -> int:
    """Shingles that a text of ``size`` shingles shares at least with one of that Jaccard similarity."""
    return int(np.ceil(similarity * size - 1e-9))


def _common_shingles(keyed: DataFrame, words: int, text_column: str, sample_docs: int, least: int = 3, most: int = 200_000) -> np.ndarray:
    """Shingles that many texts hold, rarest first, from a sample of about ``sample_docs``. Only the order of shingles
    follows from them, which decides the cost of the join and never its result."""
    step = max(1, keyed.count() // sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in encoded(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(simhash.shingle_hashes(text, words)).view(np.int64))], names=["token"])

    tokens = keyed.where(F.pmod(F.xxhash64("file", "index"), F.lit(step)) == 0).select(_text(text_column)).mapInArrow(run, "token long")
    top = tokens.groupBy("token").count().where(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(most).toPandas()
    return top["token"].to_numpy(np.int64)[::-1].view(np.uint64)


def _sketches(keyed: DataFrame, words: int, similarity: float, id_column: str, text_column: str, sample_docs: int) -> DataFrame:
    """(file, index, doc, p, q, print, n, counts, tokens, id) of each row: its key, its id, the digest of its shingle set, its
    SimHash, the size of the set and of its parts, its prefix, and a number of its own."""
    common = _common_shingles(keyed, words, text_column, sample_docs)
    by_value = np.argsort(common)
    common, place = common[by_value], by_value + 1
    names = ["p", "q", "print", "n", "counts", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                digests, prints, sizes, counts, tokens = [], [], [], [], []
                for text in encoded(batch.column(3)):
                    every = simhash.shingle_hashes(text, words)
                    own = np.unique(every)
                    late = np.zeros(len(own), np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        late = np.where(common[at] == own, place[at], 0)
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    prints.append(simhash.majority(every))
                    sizes.append(len(own))
                    counts.append(_part_counts(own))
                    tokens.append(own[np.lexsort((own, late))][: len(own) - _least_shared(len(own), similarity) + 1].view(np.int64))
                pq = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [pa.array(np.ascontiguousarray(pq[:, 0])), pa.array(np.ascontiguousarray(pq[:, 1])), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["file", "index", "doc", *names])

    kind = keyed.schema["row"].dataType[id_column].dataType.simpleString()
    rows = keyed.select("file", "index", F.col("row")[id_column].alias("doc"), _text(text_column))
    out = rows.mapInArrow(run, f"file string, index long, doc {kind}, p long, q long, print long, n int, counts binary, tokens array<long>")
    return stored(out.withColumn("id", F.monotonically_increasing_id()))


def _part_counts(own: np.ndarray) -> bytes:
    """How many of a set's shingles lie in each part of all, 255 meaning so many or more; about two to a part."""
    parts = min(max(1 << len(own).bit_length() - 1, 64), _MOST_PARTS) if len(own) else 64
    return np.minimum(np.bincount((own % parts).astype(np.int64), minlength=parts), 255).astype(np.uint8).tobytes()


def _most_shared(x: bytes, y: bytes) -> int:
    """The shingles that two sets share at most: no more of a part than the smaller count."""
    a, b = (np.frombuffer(c, np.uint8) for c in ((x, y) if len(x) <= len(y) else (y, x)))
    if max(a.max(), b.max()) == 255:
        return 1 << 40
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(0, dtype=np.int64)).sum())


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` (with an, bn, acounts, bcounts) that may be similar by the counts of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            shared = np.fromiter(map(_most_shared, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, len(n))
            good = pa.array(shared + 1e-9 >= similarity * (n - shared))
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b", "an", "bn", "acounts", "bcounts").mapInArrow(run, "a long, b long")


def _sets(keyed: DataFrame, sketches: DataFrame, wanted: DataFrame, words: int, text_column: str) -> DataFrame:
    """(id, shingles, n) of the ``wanted`` ids, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                hashes = [np.unique(simhash.shingle_hashes(t, words)).view(np.int64) for t in encoded(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.list_(pa.int64())), pa.array(list(map(len, hashes)), pa.int64())], names=["id", "shingles", "n"])

    keys = materialize(sketches.select("id", "file", "index").join(small(wanted), "id"))
    texts = marked(keyed.select("file", "index", _text(text_column)), keys, "index", ("file",)).where("marked")
    return stored(texts.join(small(keys), ["file", "index"]).select("id", "text").mapInArrow(run, "id long, shingles array<long>, n long"))


def _forests(shards: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links that span the groups within each shard. ``shards``: shard, id, part, shingles; rows of one
    part are known to belong together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, parts, held = None, [], [], []
        for batch in batches:
            values = batch.column(3)
            ends = values.offsets.to_numpy()
            flat = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (s, i, g) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if s != shard and ids:
                    yield _verified_forest(ids, parts, held, similarity)
                    ids, parts, held = [], [], []
                shard = s
                ids.append(i)
                parts.append(g)
                held.append(flat[ends[k] : ends[k + 1]].copy())
        if ids:
            yield _verified_forest(ids, parts, held, similarity)

    return shards.select("shard", "id", "part", "shingles").repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(run, "a long, b long")


def _verified_forest(ids: list[int], parts: list[int], held: list[np.ndarray], similarity: float) -> pa.RecordBatch:
    """(a, b) that span the groups of sets of at least that Jaccard similarity, given the parts that are joined already.
    A row is compared with all that are not done; rows of small groups come first, and it ends when those left are one
    group, so no pair of two groups is left out."""
    m = len(ids)
    size = np.fromiter(map(len, held), np.int64, m)
    row = np.repeat(np.arange(m), size)
    _, token = np.unique(np.concatenate(held), return_inverse=True)
    by_token = row[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token))
    begins = np.r_[0, ends[:-1]]
    starts = np.cumsum(size) - size
    _, group = np.unique(np.array(parts), return_inverse=True)
    left = np.ones(m, bool)
    a, b = [], []
    while True:
        sizes = np.bincount(group[left], minlength=m)
        if (sizes > 0).sum() < 2:
            break
        open_rows = np.flatnonzero(left)
        i = open_rows[sizes[group[open_rows]].argmin()]
        left[i] = False
        own = token[starts[i] : starts[i] + size[i]]
        if not len(own):
            continue
        count = ends[own] - begins[own]
        to = np.cumsum(count)
        shared = np.bincount(by_token[np.arange(to[-1]) + np.repeat(begins[own] - (to - count), count)], minlength=m)
        like = np.flatnonzero(left & (group != group[i]) & (shared + 1e-9 >= similarity * (size + size[i] - shared)))
        if len(like):
            joined, at = np.unique(group[like], return_index=True)
            a += [ids[i]] * len(at)
            b += [ids[k] for k in like[at].tolist()]
            group[np.isin(group, joined)] = group[i]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _named(ids: DataFrame, parts: DataFrame) -> DataFrame:
    """``ids`` (with a column id) and the part that each belongs to, itself if none."""
    return ids.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))


def _fingerprint_groups(nodes: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(id, cluster): the nodes that SimHash groups with others, by BK-trees over the distinct fingerprints."""
    prints = nodes.select("print").distinct()
    groups = connected_components(simhash.links(prints, radius, shard_rows))
    placed = nodes.select("id", "print").join(groups.withColumnRenamed("node", "print"), "print", "left")
    placed = materialize(placed.select("id", F.coalesce("component", "print").alias("cluster")))
    several = materialize(placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("cluster"))
    return materialize(placed.join(several, "cluster").select("id", "cluster"))


def _contract(members: DataFrame, known: DataFrame, similarity: float, shard_rows: int) -> DataFrame:
    """(a, b): verified links within clusters (``members``: id, cluster). Each round deals a cluster's nodes to chunks of
    about ``shard_rows``; the next round has one node for each part that is left, until nothing joins."""
    sizes = known.select("id", "n")
    links, now, turn = None, members, 0
    while True:
        weighed = materialize(now.join(sizes, "id"))
        large = weighed.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)), F.ceil(F.sum("n") / F.lit(_VALUES))).alias("chunks")).where("chunks > 1")
        large = materialize(large)
        chunk = F.pmod(F.xxhash64(F.col("id"), F.lit(turn)), F.coalesce("chunks", F.lit(1)))
        dealt = weighed.join(large, "cluster", "left").select("id", F.xxhash64("cluster", chunk).alias("shard"), F.col("id").alias("part"))
        found = materialize(_forests(dealt.join(known.select("id", "shingles"), "id"), similarity))
        links = found if links is None else links.unionByName(found)
        if large.isEmpty() or found.isEmpty():
            return links
        parts = materialize(connected_components(links))
        again = members.join(large.select("cluster"), "cluster", "left_semi")
        now = _named(again, parts).groupBy("cluster", "part").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)), "id")).alias("one")).select("cluster", "one.id")
        turn += 1


def _stripes(rows: Column, values: Column, shard_rows: int) -> Column:
    """Half shards that so many rows fill, one at least."""
    return F.greatest(F.lit(1), F.ceil(rows * 2 / F.lit(shard_rows)), F.ceil(values * 2 / F.lit(_VALUES))).cast("long")


def _size_band(n: Column, similarity: float, parts: int = 1) -> Column:
    """Bands of set sizes, ``parts`` of them from a size to the largest that can be similar to it; similar sets are in the
    same or, of one part, in neighbouring bands."""
    return F.floor(F.log(n) * parts / (max(np.log(1 / similarity), 0.01) + 1e-8)).cast("int")


def _cost(name: str, shard_rows: int) -> tuple[list[Column], Column]:
    """Aggregates of a group's rows outside (l) and inside (m) its largest part, and the sets that its shards get."""
    outside = F.col("outside")
    sums = [F.count(F.when(outside, 1)).alias("l"), F.count(F.when(~outside, 1)).alias("m"), F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("lv"), F.coalesce(F.sum(F.when(~outside, F.col("n"))), F.lit(0)).alias("mv")]
    kl, km = _stripes(F.col("l"), F.col("lv"), shard_rows), _stripes(F.col("m"), F.col("mv"), shard_rows)
    return sums, (F.col("l") * (kl + km) + F.col("m") * kl).alias(name)


def _crowded(posts: DataFrame, known: DataFrame, parts: DataFrame, similarity: float, shard_rows: int) -> DataFrame:
    """(a, b): verified links among the nodes of shingles that many share. ``posts``: id, token."""
    if posts.isEmpty():
        return posts.select(F.col("id").alias("a"), F.col("id").alias("b"))
    posts = materialize(_named(posts.join(known.select("id", "n"), "id"), parts))
    counts = posts.groupBy("token", "part").agg(F.count(F.lit(1)).alias("rows"))
    top = counts.groupBy("token").agg(F.max(F.struct("rows", "part")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    posts = materialize(posts.join(materialize(top.select("token", F.col("top.part").alias("largest"))), "token").withColumn("outside", F.col("part") != F.col("largest")))
    if posts.isEmpty():
        return posts.select(F.col("id").alias("a"), F.col("id").alias("b"))
    # shingles of one largest part go together where that sends fewer sets than each for itself
    sums, apart = _cost("apart", shard_rows)
    each = posts.groupBy("largest", "token").agg(*sums).select("largest", apart).groupBy("largest").agg(F.sum("apart").alias("apart"))
    sums, together = _cost("together", shard_rows)
    whole = posts.select("largest", "id", "n", "outside").distinct().groupBy("largest").agg(*sums).select("largest", together)
    merged = materialize(each.join(whole, "largest").where("together <= apart").select("largest", F.lit(True).alias("merged")))
    rows = posts.join(merged, "largest", "left").withColumn("group", F.when(F.col("merged"), F.xxhash64(F.lit(1), "largest")).otherwise(F.xxhash64(F.lit(0), "token")))
    rows = materialize(rows.select("group", "id", "n", "part", "outside").distinct())
    # groups of many sizes meet by bands of size, each set in its own and the next smaller one, where that sends fewer sets
    band = _size_band(F.col("n"), similarity)
    banded = rows.select("group", "n", "outside", F.explode(F.array(band, band - 1)).alias("band"))
    sums, apart = _cost("apart", shard_rows)
    apart = banded.groupBy("group", "band").agg(*sums).select("group", apart).groupBy("group").agg(F.sum("apart").alias("apart"))
    sums, together = _cost("together", shard_rows)
    by_size = materialize(rows.groupBy("group").agg(*sums).select("group", together).join(apart, "group").where("apart < together").select("group", F.lit(True).alias("by_size")))
    bands = F.when(F.col("by_size"), F.array(F.xxhash64("group", band), F.xxhash64("group", band - 1))).otherwise(F.array("group"))
    rows = materialize(rows.join(small(by_size), "group", "left").select(F.explode(bands).alias("group"), "id", "n", "part", "outside"))
    sums, _ = _cost("sets", shard_rows)
    sized = rows.groupBy("group").agg(*sums)
    one = (F.col("l") + F.col("m") <= shard_rows) & (F.col("lv") + F.col("mv") <= 2 * _VALUES)
    sized = materialize(sized.select("group", one.alias("one"), _stripes(F.col("l"), F.col("lv"), shard_rows).alias("kl"), _stripes(F.col("m"), F.col("mv"), shard_rows).alias("km")))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("kl")).otherwise(F.col("km")))
    stripes = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    among = F.transform(stripes("kl"), lambda t: F.xxhash64(F.col("group"), F.lit(0), F.least(F.col("own"), t), F.greatest(F.col("own"), t)))
    across = lambda outer, inner: F.xxhash64(F.col("group"), F.lit(1), outer, inner)
    outer = F.concat(among, F.transform(stripes("km"), lambda t: across(F.col("own"), t)))
    inner = F.transform(stripes("kl"), lambda t: across(t, F.col("own")))
    meets = F.when(F.col("one"), F.array("group")).when(F.col("outside"), outer).otherwise(inner)
    shards = rows.join(sized, "group").withColumn("own", own).select("id", "part", F.explode(meets).alias("shard"))
    return _forests(shards.join(known.select("id", "shingles"), "id"), similarity)


def _candidates(sketches: DataFrame, shared: DataFrame, several: DataFrame, similarity: float, shard_rows: int, few: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to be verified, and (id, token) of the nodes that meet in shards. ``shared``: a token, its rows and its
    first and last node; ``several``: id, n, token, rows of the tokens of more than two rows.

    Of two prefixes' last shingles one comes first in the common order. What a pair shares up to it lies in both prefixes;
    what it shares beyond it is no more than that text has beyond its prefix. So a similar pair shares at least ``needed``
    shingles of the prefixes. If a text has fewer crowded ones (``h``) than that, the pair shares others too. A text with as
    many as a pair of its own size needs is called heavy; two heavy texts meet in shards."""

    def needed(an, bn):
        beyond = F.greatest(*[F.ceil(F.col(n) * similarity - 1e-9) - 1 for n in (an, bn)])
        return F.ceil((similarity * (F.col(an) + F.col(bn)) - 1e-6) / (1 + similarity)) - beyond

    crowded = several.where((F.col("rows") > few) & (F.col("rows") <= shard_rows))
    h = materialize(crowded.groupBy("id").agg(F.count(F.lit(1)).alias("h")))
    crowded = materialize(crowded.join(h, "id").withColumn("heavy", F.col("h") >= needed("n", "n")))
    side = lambda df, x, *more: df.select("token", *[F.col(c).alias(x + c) for c in ("id", "n", *more)])
    rare = several.where(F.col("rows") <= few)
    sizes = F.least("an", "bn") + 1e-9 >= similarity * F.greatest("an", "bn")
    met = side(rare, "a").join(side(rare, "b"), "token").where(F.col("aid") < F.col("bid")).where(sizes).selectExpr("aid a", "bid b")
    alone = ~(F.col("aheavy") & F.col("bheavy")) & (needed("an", "bn") <= F.least("ah", "bh"))
    # the smaller text of a pair goes to the bands of all sizes at which its crowded shingles alone may be enough
    least = F.greatest(F.col("an"), (F.col("an") - (1 + similarity) / similarity * (F.col("ah") + 1e-6)) / similarity)
    bands = F.sequence(_size_band(least * (1 - 1e-9), similarity, 4), _size_band(F.col("an") / similarity * (1 + 1e-9), similarity, 4))
    smaller = side(crowded, "a", "h", "heavy").withColumn("band", F.explode(bands))
    larger = side(crowded, "b", "h", "heavy").withColumn("band", _size_band(F.col("bn"), similarity, 4))
    once = F.struct("an", "aid") < F.struct("bn", "bid")
    more = smaller.join(larger, ["token", "band"]).where(once & sizes & alone).select(F.least("aid", "bid").alias("a"), F.greatest("aid", "bid").alias("b"))
    met = materialize(shared.where("rows = 2").select("a", "b").unionByName(met).unionByName(more).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")))
    hint = F.broadcast if met.count() <= 200_000 else (lambda x: x)
    size = lambda x, *more: sketches.select(F.col("id").alias(x), *[F.col(c).alias(x + c) for c in ("n", *more)])
    met = size("b").join(hint(size("a").join(hint(met), "a")), "b").where(sizes)
    for x in ("a", "b"):
        met = met.join(small(h).withColumnsRenamed({"id": x, "h": x + "h"}), x, "left")
    pairs = materialize(met.where(F.col("c") + F.coalesce(F.least("ah", "bh"), F.lit(0)) * (F.col("ah").isNotNull() & F.col("bh").isNotNull()).cast("int") >= needed("an", "bn")).select("a", "b"))
    n = pairs.count()
    counted = size("a", "counts").join(F.broadcast(pairs) if n <= 200_000 else pairs, "a")
    # the counts are some 300 bytes a pair
    pairs = materialize(_possible(size("b", "counts").join(F.broadcast(counted) if n <= 100_000 else counted, "b"), similarity))
    heavy = crowded.where("heavy").select("id", "token")
    meeting = heavy.groupBy("token").agg(F.count(F.lit(1)).alias("together")).where("together > 1").select("token")
    crowd = heavy.join(materialize(meeting), "token").select("id", "token").unionByName(several.where(F.col("rows") > shard_rows).select("id", "token"))
    return pairs, materialize(crowd)


def _groups(keyed: DataFrame, words: int, similarity: float, id_column: str, text_column: str, radius: int, shard_rows: int, few: int, sample_docs: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and (p, q, component, rows) of the sets that belong to several rows."""
    sketches = _sketches(keyed, words, similarity, id_column, text_column, sample_docs)
    nodes = materialize(sketches.groupBy("p", "q").agg(F.min("id").alias("id"), F.min("print").alias("print"), F.count(F.lit(1)).alias("rows")))
    clusters = _fingerprint_groups(nodes, radius, shard_rows)
    copies = small(materialize(sketches.select("id", "p", "q").join(nodes.where("rows > 1").select("p", "q", F.col("id").alias("node")), ["p", "q"]).where("id <> node").select("id")), 1_000_000)
    posts = sketches.select("id", "n", "tokens").join(copies, "id", "left_anti").select("id", "n", F.explode("tokens").alias("token"))
    # most tokens occur once, so that sums by task before the shuffle would only make its rows wider
    shared = materialize(posts.select("token", "id").repartition("token").groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    several = materialize(shared.where("rows > 2").select("token", "rows"))
    few_tokens = several.count() <= _TOKENS
    held = posts if few_tokens else marked(posts, several, f"token & {(1 << 27) - 1}").where("marked").drop("marked")
    several = materialize(held.join(F.broadcast(several) if few_tokens else several, "token"))
    pairs, crowd = _candidates(sketches, shared, several, similarity, shard_rows, few)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd.select("id")).unionByName(clusters.select("id"))
    known = _sets(keyed, sketches, materialize(wanted.distinct()), words, text_column)
    links = _contract(clusters, known, similarity, shard_rows)
    parts = materialize(connected_components(links))
    rest = _named(_named(pairs.withColumnRenamed("a", "id"), parts).selectExpr("id a", "part ap", "b id"), parts).where("ap <> part").selectExpr("a", "id b")
    held = lambda x, y: known.select(F.col("id").alias(x), F.col("shingles").alias(y))
    both = materialize(rest).join(held("a", "x"), "a").join(held("b", "y"), "b")
    size = F.size(F.array_intersect("x", "y"))
    verified = both.where(size + 1e-9 >= similarity * (F.size("x") + F.size("y") - size)).select("a", "b")
    links = links.unionByName(verified).unionByName(_crowded(crowd, known, parts, similarity, shard_rows))
    component = connected_components(links).withColumnRenamed("node", "id")
    named = nodes.join(component, "id", "left").where("rows > 1 or component is not null")
    return sketches, materialize(named.select("p", "q", F.coalesce("component", "id").alias("component"), "rows"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text", radius: int = 4, shard_rows: int = 4096, few: int = 32, sample_docs: int = 8_000) -> DataFrame:
    """(node, component) of every row with an id: the smallest id of its group of near-duplicates, its own if it has none.

    Near-duplicates have a Jaccard similarity of at least ``similarity`` on distinct ``words``-word shingles, and the join
    is exact. ``radius`` and ``shard_rows`` are of the SimHash search, ``few`` and ``sample_docs`` of the join; none of
    them changes the result. Null and empty texts are one group; rows with a null id take part and get no row; an empty
    table gives an empty result; ids may be of any type that has an order; other columns may have any name."""
    sketches, named = _groups(keyed_rows(docs), words, similarity, id_column, text_column, radius, shard_rows, few, sample_docs)
    members = sketches.select("doc", "p", "q").where("doc is not null").join(small(named), ["p", "q"], "left")
    least = members.where("component is not null").groupBy("component").agg(F.min("doc").alias("least"))
    return members.join(materialize(least), "component", "left").select(F.col("doc").alias("node"), F.coalesce("least", "doc").alias("component"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text", **search: int) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id; null ids come last.

    Rows are told apart by their place in their file or in a written copy, so that rows that repeat an id, or have none,
    are judged each by its own text. Null and empty texts are one group, of which one row stays; a row with neither id nor
    text always stays. An empty table stays empty. ``search``: see ``similar_groups``."""
    options = {"radius": 4, "shard_rows": 4096, "few": 32, "sample_docs": 8_000} | search
    keyed = keyed_rows(docs)
    usable = keyed.where(F.col("row")[id_column].isNotNull() | F.col("row")[text_column].isNotNull())
    sketches, named = _groups(usable, words, similarity, id_column, text_column, **options)
    order = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("id").alias("id"))
    members = materialize(sketches.select("file", "index", "p", "q", "id", order.alias("order")).join(small(named), ["p", "q"]).select("file", "index", "id", "component", "order"))
    first = materialize(members.groupBy("component").agg(F.min("order").alias("first")).select(F.col("first.id").alias("id")))
    out = members.join(first, "id", "left_anti").select("file", "index")
    return marked(keyed, out, "index", ("file",)).where("not marked").select("row.*")
