"""Ranked lexical search: all documents ranked for each item by a weighted sum over the item's terms, in whole numbers.

The documents become a sparse term-document matrix, restricted to the items' terms, one row of the stored table for each
document. Items come in blocks of bounded size. For a block, each Arrow batch of documents is a block of columns: its
entries become 64-bit impacts, and the product with the item-term multiplicities is formed row by row, merging the
matrix rows of an item's terms into one accumulator. A task keeps each item's k best so far, so that k rows for each item
and task reach the shuffle, however many documents match."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandsift.llm.common import encoded, materialize, stored

#: UTF-8 bytes to bytes: A-Z to a-z, other ASCII but letters and digits to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """(item, term, times): rows of one item id, null ids included, are one item."""
    kind = to_arrow_type(items.schema[item_column].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(encoded(batch.column(1))):
                found = Counter(terms(text))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(found), kind), pa.array([t.decode("utf-8", "replace") for t in found]), pa.array(list(found.values()), pa.int64())], names=["item", "term", "times"])

    counted = items.select(F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"item {items.schema[item_column].dataType.simpleString()}, term string, times long")
    return counted.groupBy("item", "term").agg(F.sum("times").alias("times"))


def term_documents(docs: DataFrame, vocabulary: list[str], id_column: str, text_column: str) -> DataFrame:
    """(doc, n, terms, tf): of each document with a term its number of terms, and the places in ``vocabulary`` of those
    that it holds, ascending, with how often. As a stored table, so that texts are read once."""
    kind = docs.schema[id_column].dataType
    sent = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary, 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value.get
        names = ["doc", "n", "terms", "tf"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                sizes, ends, found, times = [], [0], [], []
                for text in encoded(part.column(1)):
                    own = terms(text)
                    counts = Counter(filter(None, map(place, own)))
                    at = sorted(counts)
                    found += at
                    times += map(counts.__getitem__, at)
                    ends.append(len(found))
                    sizes.append(len(own))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.array(x, kind), t)) for x, kind, t in ((np.array(found, np.int64) - 1, np.int32, pa.int32()), (times, np.int64, pa.int64()))]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *lists], names=names)
                yield out.filter(pc.greater(out.column(1), 0))

    texts = docs.select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("text"))
    return stored(texts.mapInArrow(run, f"doc {kind.simpleString()}, n long, terms array<int>, tf array<long>"))


class Best:
    """The k best of each item among the blocks seen so far: (-score, null id, id), ascending."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(items)]

    def take(self, item: int, scores: np.ndarray, order: np.ndarray, ids: pa.Array) -> None:
        """``scores`` of a block's documents, whose ids are ``ids``, ``order`` being the ids' places in ascending order."""
        mine = self.rows[item]
        at = np.flatnonzero(scores >= (-mine[-1][0] if len(mine) == self.k else 1))
        if len(at) > self.k:
            own = scores[at]
            at = at[own >= np.partition(own, len(own) - self.k)[len(own) - self.k]]
            at = at[np.lexsort((order[at], -scores[at]))[: self.k]]
        if len(at):
            own = ids.take(pa.array(at)).to_pylist()
            self.rows[item] = sorted([*mine, *((-s, d is None, 0 if d is None else d) for s, d in zip(scores[at].tolist(), own, strict=True))])[: self.k]


def product(block: pa.RecordBatch, rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, best: Best) -> None:
    """One block of the product: ``block`` has the columns of term_documents, ``rows`` each item's terms and multiplicities."""
    n = block.column(1).to_numpy(zero_copy_only=False)
    m = 75 + (25 * n * n_docs) // n_terms
    lengths = block.column(2).value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(n)), lengths)
    term, tf = (block.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    by_term = np.argsort(term, kind="stable")
    doc, impact = doc[by_term], impact[by_term]
    ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(weights)))])
    order = np.empty(len(n), np.int64)
    order[pc.sort_indices(block.column(0), null_placement="at_end").to_numpy()] = np.arange(len(n))
    sums = np.zeros(len(n), np.int64)
    for item, (own, times) in enumerate(rows):
        begins, stops = ends[own], ends[own + 1]
        met = np.flatnonzero(stops > begins)
        if not len(met):
            continue
        sums[:] = 0
        for b, e, x in zip(begins[met].tolist(), stops[met].tolist(), times[met].tolist(), strict=True):
            sums[doc[b:e]] += x * impact[b:e]  # a term's documents are distinct
        best.take(item, sums, order, block.column(0))


def _block(docs: DataFrame, counted: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame | None:
    """(item, doc, score): of one block of items, whose terms come to the driver, the k best of each task."""
    found = counted.collect()  # bounded by block_terms, or one item's distinct terms
    vocabulary = sorted({r.term for r in found})
    if not vocabulary:
        return None
    matrix = term_documents(docs, vocabulary, id_column, text_column)
    n_docs, n_terms = matrix.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    held = np.zeros(len(vocabulary), np.int64)
    for t, df in matrix.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():  # one row a term
        held[t] = df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    by: dict = {}
    for r in found:
        own = by.setdefault(r.item, ([], []))
        own[0].append(place[r.term])
        own[1].append(r.times)
    names, rows = list(by), [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in by.values()]
    sent = docs.sparkSession.sparkContext.broadcast((names, rows, weights))
    kinds = [counted.schema["item"].dataType, matrix.schema["doc"].dataType]
    item_type, doc_type = (to_arrow_type(x) for x in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, weights = sent.value
        best = Best(len(names), k)
        for batch in batches:
            if batch.num_rows:
                product(batch, rows, weights, n_docs, n_terms, best)
        flat = [(item, None if null else d, -s) for item, own in zip(names, best.rows, strict=True) for s, null, d in own]
        for begin in range(0, len(flat), 10_000):
            a, b, c = zip(*flat[begin : begin + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, item_type), pa.array(b, doc_type), pa.array(c, pa.int64())], names=["item", "doc", "score"])

    return matrix.select("doc", "n", "terms", "tf").mapInArrow(run, f"item {kinds[0].simpleString()}, doc {kinds[1].simpleString()}, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text", block_terms: int = 500_000) -> DataFrame:
    """(item column, rank, id column, score): the ``k`` documents of highest score above 0 of each item, equal scores by
    ascending id, null ids last.

    A term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))), its impact on a document w ((10^9 tf) div (1000 tf + 12 m))
    with m = 75 + ((25 n N) div L); an item's score is the sum over its terms, repeats included. N documents have terms, L
    terms in all, n in this one.

    Each row of ``docs`` is a document, so that an id on several rows may come several times; rows of one item id are one
    item. Null and empty texts have no terms: such documents count nowhere, and such items have no row; nor has any item if
    the documents are empty. Texts of any length are read whole; other columns, whatever their names, are ignored.

    Items are dealt to blocks of about ``block_terms`` distinct (item, term) each; of one block after another the terms
    come to the driver, and the result is written."""
    counted = materialize(item_terms(items, item_column, text_column))
    blocks = max(1, -(-counted.count() // block_terms))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    done = []
    for b in range(blocks):
        part = counted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else counted
        found = _block(docs, part, k, id_column, text_column)
        if found is not None:
            own = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            done.append(stored(own) if blocks > 1 else own)
    shown = [F.col("item").alias(item_column), F.col("rank"), F.col("doc").alias(id_column), F.col("score")]
    if not done:
        return items.select(F.col(item_column).alias("item")).limit(0).join(docs.select(F.col(id_column).alias("doc")).limit(0), F.lit(True)).select("item", "doc", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("score")).select(*shown)
    return reduce(DataFrame.unionByName, done).select(*shown)
