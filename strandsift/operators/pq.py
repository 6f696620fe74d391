"""Nearest neighbours by a scan over product-quantised codes.

Vectors are cut into parts, each part is coded as the number of its nearest entry in a codebook learnt on a bounded
sample, and the table keeps one byte a part beside the vector. A scan reads codes alone and scores a row by one look-up
a part. The distance between a vector and what its codes stand for is kept too, so each look-up score has an upper and
a lower bound: rows whose upper bound does not reach the k-th best lower bound are no hits, the others are scored from
their vectors in the same batch, and the result equals that of a search over all. With ``shortlist`` the rows of the best look-up scores
are taken instead, so many a query, and the result is approximate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandsift.operators.ivf import _units, sample_units
from strandsift.operators.search import _BLOCK_VALUES, DIGITS, _blocks, _matrices, _pair_scores, _parts, _slices, top_k
from strandsift.sources.shared import one_by_one, scratch

#: How far rounding may move a score, errors being kept as floats.
_SLACK = 1e-6
#: (row, query) pairs up to which candidates are broadcast to the vectors; beyond, both sides are shuffled by row.
_BROADCAST_PAIRS = 1_000_000
#: (row, query) pairs that a task scores at once.
_PAIRS = 500_000
#: Queries whose look-up tables (16 parts: 32 KB each) a task holds at once.
_TABLES = 500


@dataclass
class PqIndex:
    """A table at ``path`` (row, id, embedding, codes, error) of ``rows`` rows; ``books``: one array of entries a part. ``rescored``
    and ``pairs`` add up, over all searches, how many (query, row) pairs were scored from their vectors, of how many."""

    path: str
    books: list[np.ndarray]
    rows: int
    id_type: str
    rescored: int = field(default=0)
    pairs: int = field(default=0)

    @property
    def size(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"row long, id {self.id_type}, embedding array<float>, codes binary, error float").parquet(self.path)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1)[None, :] / 2 - x @ book.T).argmin(1)


def learn_books(database: DataFrame, parts: int = 16, sample_rows: int = 20_000, rounds: int = 8, seed: int = 1) -> list[np.ndarray]:
    """Codebooks of at most 256 entries for each of ``parts`` runs of components, by k-means over a sample in the driver."""
    x = sample_units(database, sample_rows)
    draw = np.random.default_rng(seed)
    books = []
    for columns in np.array_split(np.arange(x.shape[1]), max(1, min(parts, x.shape[1]))) if len(x) else []:
        own = x[:, columns]
        distinct = np.unique(own, axis=0)
        book = distinct[draw.choice(len(distinct), min(256, len(distinct)), replace=False)]
        for _ in range(rounds):
            at = _nearest(own, book)
            n = np.bincount(at, minlength=len(book))
            sums = np.stack([np.bincount(at, own[:, c], len(book)) for c in range(own.shape[1])], 1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        books.append(book)
    return books


def build_pq(database: DataFrame, path: str | None = None, parts: int = 16, sample_rows: int = 20_000) -> PqIndex:
    """An index of all rows of ``database`` (id, embedding) at ``path`` (default: in the shared folder). Null vectors, and those
    with a NaN or an infinite component or of another length than most of the sample, are never hits and left out."""
    spark = database.sparkSession
    books = learn_books(database, parts, sample_rows)
    index = PqIndex(path or scratch(spark, "pq"), books, 0, database.schema["id"].dataType.simpleString())
    if not books:
        return index
    size, borders = index.size, np.cumsum([0] + [b.shape[1] for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, x = _units(batch.column(2), size)
            good = np.isfinite(x).all(1)
            kept, x = batch.filter(pa.array(fits)).filter(pa.array(good)), x[good]
            codes, left = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x))
            for i, book in enumerate(books):
                own = x[:, borders[i] : borders[i + 1]]
                codes[:, i] = at = _nearest(own, book)
                left += ((own - book[at]) ** 2).sum(1)
            error = np.nextafter(np.sqrt(left).astype(np.float32), np.float32(np.inf))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float32())], names=["row", "id", "embedding", "codes", "error"])

    # a row's number is drawn and written by one task, so it is unique, and it is read from the table ever after
    numbered = database.select(F.monotonically_increasing_id().alias("row"), "id", F.col("embedding").cast("array<float>").alias("embedding"))
    numbered.mapInArrow(run, f"row long, id {index.id_type}, embedding array<float>, codes binary, error float").write.parquet(index.path)
    index.rows = index.table(spark).count()
    return index


def _tables(books: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """What each code adds to the score of each query: (parts, queries, 256)."""
    out = np.zeros((len(books), len(q), 256))
    at = 0
    for i, book in enumerate(books):
        out[i, :, : len(book)] = q[:, at : at + book.shape[1]] @ book.T
        at += book.shape[1]
    return out


def _look_up(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.zeros((tables.shape[1], len(codes)))
    for i, table in enumerate(tables):
        out += table[:, codes[:, i]]
    return out


def _few(n: int, rows: int, cells: int) -> Iterator[slice]:
    """``_slices`` of so few queries that their look-up tables, which are made where they are used, are small too."""
    return _slices(n, max(rows, cells // _TABLES), cells)


def _scan(spark: SparkSession, index: PqIndex, ids: np.ndarray, q: np.ndarray, norms: np.ndarray, exclude_self: bool, schema: str, keep) -> DataFrame:
    """``keep`` (first query, look-up scores, their errors, rows) over each Arrow batch of codes and slice of queries."""
    sent = spark.sparkContext.broadcast((ids, index.books, q, norms))
    names = schema.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, books, q, norms = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            error = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            row = batch.column(0).to_numpy(zero_copy_only=False)
            named = np.array(batch.column(3).to_pylist(), object) if exclude_self else None
            for part in _few(len(own_ids), len(row), 2_000_000):
                s = _look_up(_tables(books, q[part]), codes)
                if exclude_self:
                    s[own_ids[part][:, None] == named[None, :]] = -np.inf
                yield pa.RecordBatch.from_arrays(keep(part.start, s, norms[part][:, None] * error[None, :] + _SLACK, row), names=names)

    columns = ["row", "codes", "error"] + (["id"] if exclude_self else [])
    return index.table(spark).select(*columns).mapInArrow(run, schema)


def _last(spark: SparkSession, scan, queries: int, k: int) -> np.ndarray:
    """Each query's k-th best lower bound; one row a query comes to the driver."""

    def keep(start, s, error, row):
        n = min(k, s.shape[1])
        best = -np.partition(error - s, n - 1, axis=1)[:, :n]
        return [pa.array(np.repeat(np.arange(start, start + len(s), dtype=np.int32), n)), pa.array(best.ravel())]

    order = Window.partitionBy("place").orderBy(F.desc("low"))
    best = scan("place int, low double", keep).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    least = np.full(queries, -np.inf)
    for r in best.groupBy("place").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect():
        least[r.place] = r.low
    return least


def _reached(spark: SparkSession, index: PqIndex, ids: np.ndarray, q: np.ndarray, norms: np.ndarray, least: np.ndarray, exclude_self: bool, k: int) -> DataFrame:
    """(query_id, db_id, score, n): of each Arrow batch and slice of queries the ``k`` best by their vectors, of the rows whose
    upper bound reaches the query's k-th lower bound; queries by place. A slice's first row counts in n the pairs scored from their
    vectors. No pair leaves its batch otherwise, and a slice has ``_PAIRS`` pairs at most, or one query's."""
    sent = spark.sparkContext.broadcast((ids, index.books, q, norms, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, books, q, norms, least = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            error = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            named = np.array(batch.column(0).to_pylist(), object) if exclude_self else None
            x = None
            for part in _few(len(own_ids), batch.num_rows, _PAIRS):
                s = _look_up(_tables(books, q[part]), codes)
                if exclude_self:
                    s[own_ids[part][:, None] == named[None, :]] = -np.inf
                s[(s + norms[part][:, None] * error[None, :] + _SLACK) < least[part, None]] = -np.inf
                which, at = np.nonzero(s > -np.inf)
                if not len(at):
                    continue
                if x is None:
                    _, x = _units(batch.column(1), q.shape[1])
                # many pairs are one product, few are scored each
                score = (q[part] @ x.T)[which, at] if 4 * len(at) > s.size else _pair_scores(q[part], x, which, at)
                best = _best_of(which, score, k)  # the final cut decides between ties
                # the first row stays for its count, others if they reach what the k-th best has at least
                best = best[(score[best] >= least[part][which[best]] - _SLACK) | (np.arange(len(best)) == 0)]
                n = np.zeros(len(best), np.int64)
                n[0] = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(which[best] + part.start, pa.int32()), batch.column(0).take(pa.array(at[best])), pa.array(_pair_scores(q[part], x, which[best], at[best])), pa.array(n)], names=["query_id", "db_id", "score", "n"])

    return index.table(spark).select("id", "embedding", "codes", "error").mapInArrow(run, f"query_id int, db_id {index.id_type}, score double, n long")


def _short(scan, n_best: int) -> DataFrame:
    """(row, places): the queries for which a row is among the best look-up scores."""

    def keep(start, s, error, row):
        n = min(n_best, s.shape[1])
        at = np.argpartition(-s, n - 1, axis=1)[:, :n]
        which = np.repeat(np.arange(len(s)), n)
        at = at.ravel()
        real = s[which, at] > -np.inf
        which, at = which[real], at[real]
        return [pa.array(row[at]), pa.array(which + start, pa.int32()), pa.array(s[which, at])]

    order = Window.partitionBy("place").orderBy(F.desc("score"), "row")
    best = scan("row long, place int, score double", keep).withColumn("n", F.row_number().over(order)).where(F.col("n") <= n_best)
    return best.groupBy("row").agg(F.collect_list("place").alias("places"))  # at most one block of queries


def _best_of(place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are among the ``k`` best of their place, with all that may tie with the last when rounded."""
    order = np.lexsort((-score, place))
    p, s = place[order], score[order]
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(p)))
    last = s[first + np.minimum(sizes, k) - 1]
    return order[s >= np.repeat(last, sizes) - 2 * 10.0**-DIGITS]


def _rescored(index: PqIndex, found: DataFrame, pairs: int, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, db_id, score) of the candidates, from their vectors, the k best of each Arrow batch; queries by place."""
    spark = found.sparkSession
    sent = spark.sparkContext.broadcast(q)
    vectors = index.table(spark).select("row", "id", "embedding")
    met = vectors.join(F.broadcast(found) if pairs <= _BROADCAST_PAIRS else found, "row").select("id", "embedding", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            _, x = _units(batch.column(1), q.shape[1])
            places = batch.column(2)
            ends = np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))
            every = places.flatten().to_numpy(zero_copy_only=False)
            for i in range(0, len(every), _PAIRS):
                asked = every[i : i + _PAIRS]
                of = np.searchsorted(ends, np.arange(i, i + len(asked)), "right")
                s = _pair_scores(q, x, asked, of)
                best = _best_of(asked, s, k)  # the final cut decides between ties
                yield pa.RecordBatch.from_arrays([pa.array(asked[best], pa.int32()), batch.column(0).take(pa.array(of[best])), pa.array(s[best])], names=["query_id", "db_id", "score"])

    return met.mapInArrow(run, f"query_id int, db_id {index.id_type}, score double")


def search_pq(index: PqIndex, queries: DataFrame, k: int = 10, shortlist: int | None = None, exclude_self: bool = False, block_values: int = _BLOCK_VALUES // 16) -> DataFrame:
    """(query_id, rank, db_id, score): as ``search.search`` over the indexed rows, ties by db_id. ``shortlist``: score only the
    rows of so many best look-up scores a query (at least k), which may miss hits.

    Queries without a vector, or with one of another length than the index has, have no row; NaN scores are never hits;
    a repeated query id is answered once per row. Queries come in blocks of bounded size, one after another."""
    queries = queries.select("id", "embedding").where("embedding is not null")
    spark = queries.sparkSession
    kind = queries.schema["id"].dataType.simpleString()
    blocks = _blocks(queries, block_values)

    def best(part: DataFrame) -> DataFrame:
        matrices = _matrices(part)
        if not index.rows or index.size not in matrices:
            return spark.createDataFrame([], f"query_id {kind}, rank int, db_id {index.id_type}, score double")
        ids, q = matrices[index.size]
        good = np.isfinite(q).all(1)
        ids, q = ids[good], q[good]
        norms = np.sqrt((q * q).sum(1))
        scan = lambda schema, keep: _scan(spark, index, ids, q, norms, exclude_self, schema, keep)
        path = scratch(spark, "pq-found")
        if shortlist:
            _short(scan, max(k, shortlist)).write.parquet(path)
            found = spark.read.schema("row long, places array<int>").parquet(path)
            pairs = found.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
            scored = _rescored(index, found, pairs, q, k)
        else:
            _reached(spark, index, ids, q, norms, _last(spark, scan, len(q), k), exclude_self, k).write.parquet(path)
            scored = spark.read.schema(f"query_id int, db_id {index.id_type}, score double, n long").parquet(path)
            pairs = scored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            scored = scored.drop("n")
        index.pairs += len(q) * index.rows
        index.rescored += pairs
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids.tolist())], f"place int, id {kind}")
        hits = top_k(scored, k).withColumnRenamed("query_id", "place")
        return hits.join(F.broadcast(names), "place").select(F.col("id").alias("query_id"), "rank", "db_id", "score")  # one block of queries

    return one_by_one((best(p) for p in _parts(queries, blocks)), blocks > 1)
