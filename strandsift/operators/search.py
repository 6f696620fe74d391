"""Exact nearest neighbours: score every query against every vector and keep the k best.

Two plans give the same rows. 'native' is all Catalyst: a broadcast block of queries, scores by built-in expressions, and
a row_number that Spark turns into partial and final group limits. From a number of pairs on, a sample of the database
first gives each query a score that its k best reach, and the join lets no other pair out. 'blocks' multiplies each Arrow batch
of the database with a block of queries in numpy and keeps the k best of each batch, so that only k rows per query and
batch reach the shuffle. 'auto' takes 'blocks' from a number of pairs on. Queries always come in blocks of bounded
size, one after another where there are several; the database is never broadcast nor collected."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandsift.functions import vector
from strandsift.sources.shared import one_by_one, scratch

#: Scores are compared after rounding, so that the order of summation does not decide ties.
DIGITS = 9
_BLOCK_VALUES = 16_000_000
_NATIVE_PAIRS = 30_000
#: Components up to which a vector is laid out as columns, so that Spark compiles its product; lengths of which this is done.
_FLAT_SIZE = 256
_FLAT_SIZES = 8
#: Scores that one Arrow batch has at most, or one row's.
_OUT_ROWS = 1 << 19


def _parts(queries: DataFrame, blocks: int) -> Iterator[DataFrame]:
    """``queries`` in so many blocks by the hash of the id."""
    return (queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries for b in range(blocks))


def _blocks(queries: DataFrame, values: int) -> int:
    """Blocks of about ``values`` vector components at most."""
    size, rows = queries.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    return max(1, -(-max(size or 0, 1) * rows // values))


def _slices(n: int, width: int, cells: int = 4_000_000) -> Iterator[slice]:
    """``n`` queries in slices whose scores against ``width`` rows have about ``cells`` cells at most."""
    step = max(1, cells // max(width, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.sqrt(np.einsum("ij,ij->i", m, m)) + vector.EPSILON)[:, None]


def _pair_scores(q: np.ndarray, x: np.ndarray, of: np.ndarray, at: np.ndarray, step: int = 100_000) -> np.ndarray:
    """The products of the rows ``of`` of q with the rows ``at`` of x, in runs; they do not depend on which pairs are scored together,
    as those of a product of matrices may in the last bits."""
    runs = [np.einsum("ij,ij->i", q[of[i : i + step]], x[at[i : i + step]]) for i in range(0, len(of), step)]
    return np.concatenate(runs) if runs else np.zeros(0)


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of each length; null vectors are in none."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)


def _score_block(part: DataFrame, database: DataFrame, unit: bool) -> DataFrame:
    """All pairs of one block of queries with the database, each Arrow batch multiplied with the block. Pairs of a null
    vector or of unlike lengths have null scores."""
    kinds = [x.schema["id"].dataType for x in (part, database)]
    id_type = to_arrow_type(kinds[0])
    rows = part.select("id", "embedding").collect()  # one block
    own = pa.array([r.id for r in rows], id_type)
    vectors = list(_by_size(pa.array([r.embedding for r in rows], pa.list_(pa.float64()))))
    sent = part.sparkSession.sparkContext.broadcast((own, {m.shape[1]: (at, _unit(m) if unit else m) for at, m in vectors}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = sent.value
        for whole in batches if len(own) else ():
            step = max(1, _OUT_ROWS // len(own))
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                score = np.zeros((len(own), batch.num_rows))
                unknown = np.ones(score.shape, bool)
                for at, d in _by_size(batch.column(1)):
                    if d.shape[1] in asked:
                        places, q = asked[d.shape[1]]
                        met = np.ix_(places, at)
                        score[met], unknown[met] = q @ (_unit(d) if unit else d).T, False
                query = own.take(pa.array(np.repeat(np.arange(len(own)), batch.num_rows)))
                found = batch.column(0).take(pa.array(np.tile(np.arange(batch.num_rows), len(own))))
                yield pa.RecordBatch.from_arrays([query, found, pa.array(score.ravel(), mask=unknown.ravel() if unknown.any() else None)], names=["query_id", "db_id", "score"])

    return database.select("id", "embedding").mapInArrow(run, f"query_id {kinds[0].simpleString()}, db_id {kinds[1].simpleString()}, score double")


def _spread(database: DataFrame, held: int, each: int = 1) -> DataFrame:
    """A small table is one file split, and one core would do the whole product; a large one stays where it is. ``each``: tasks a
    core."""
    tasks = each * database.sparkSession.sparkContext.defaultParallelism
    return database.repartition(tasks) if held < tasks else database


def _scores(queries: DataFrame, database: DataFrame, unit: bool, values: int) -> DataFrame:
    blocks = _blocks(queries, values)
    database = _spread(database.select("id", "embedding"), database.select(F.spark_partition_id()).distinct().count())
    return one_by_one((_score_block(p, database, unit) for p in _parts(queries, blocks)), blocks > 1)


def dot_scores(queries: DataFrame, database: DataFrame, block_values: int = _BLOCK_VALUES) -> DataFrame:
    """(query_id, db_id, score): plain dot products. Both inputs have columns id and embedding. Queries are broadcast in
    blocks of about ``block_values`` components at most, one after another."""
    return _scores(queries, database, False, block_values)


def cosine_scores(queries: DataFrame, database: DataFrame, block_values: int = _BLOCK_VALUES) -> DataFrame:
    """(query_id, db_id, score): as dot_scores, of unit vectors."""
    return _scores(queries, database, True, block_values)


def top_k_dot(queries: DataFrame, database: DataFrame, k: int, block_values: int = _BLOCK_VALUES) -> DataFrame:
    """(query_id, rank, db_id, score): as top_k over dot_scores; each Arrow batch keeps its k best, so that not all pairs are
    sorted. Query ids should be unique."""
    queries, database = queries.select("id", "embedding"), database.select("id", "embedding")
    return search(queries, database, k, "blocks", block_values=block_values, unit=False)


def _native_cosines(queries: DataFrame, database: DataFrame) -> DataFrame:
    """cosine_scores as one Catalyst plan over one block of queries, both sides being normalised once, below the join."""
    unit = lambda df, name, v: df.select(F.col("id").alias(name), F.explode(F.array(vector.l2_normalize(F.col("embedding")))).alias(v))
    met = unit(database, "db_id", "_d").crossJoin(F.broadcast(unit(queries, "query_id", "_q")))
    return met.select("query_id", "db_id", vector.dot(F.col("_q"), F.col("_d")).alias("score"))


def _flat(df: DataFrame, name: str, prefix: str, size: int, *more: str) -> DataFrame:
    """Unit vectors of ``size`` components as columns that are never null; those with a null or NaN component are left out, as
    they have no score."""
    unit = df.where(F.size("embedding") == size).select(F.col("id").alias(name), *more, vector.l2_normalize(F.col("embedding")).alias("_u"))
    known = unit.where(vector.total(F.col("_u")).isNotNull() & ~F.isnan(vector.total(F.col("_u"))))
    return known.select(name, *more, *[F.coalesce(F.get("_u", F.lit(i)), F.lit(0.0)).alias(f"{prefix}{i}") for i in range(size)])


def _flat_cosines(queries: DataFrame, database: DataFrame, size: int, low: DataFrame | None = None) -> DataFrame:
    """_native_cosines of the vectors of ``size`` components, their product being compiled; only pairs of at least the query's
    score in ``low`` (asked, low), if it has one there."""
    score = _summed([F.col(f"_q{i}") * F.col(f"_d{i}") for i in range(size)])
    if low is not None:
        bound = queries.join(low, F.col("id").eqNullSafe(F.col("asked")), "left")
        queries = bound.select("id", "embedding", F.coalesce("low", F.lit(float("-inf"))).alias("low"))
    met = _flat(database, "db_id", "_d", size).crossJoin(F.broadcast(_flat(queries, "query_id", "_q", size, *(["low"] if low is not None else []))))
    return (met if low is None else met.where(score >= F.col("low"))).select("query_id", "db_id", score.alias("score"))


def _summed(terms: list[Column]) -> Column:
    """In pairs, so that sums do not wait for each other."""
    while len(terms) > 1:
        terms = [reduce(Column.__add__, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def _native_top_k(queries: DataFrame, database: DataFrame, rows: int, k: int, sizes: list[int], exclude_self: bool) -> DataFrame:
    """The ``k`` best of many pairs. One row in the root of ``rows`` / ``k`` is a sample, whose k-th best score no hit falls short
    of: what is sorted for a query grows with the root of ``rows``."""
    spark = queries.sparkSession
    every = max(1, int((rows / max(k, 1)) ** 0.5))
    other = lambda df: df.where(~F.col("query_id").eqNullSafe(F.col("db_id"))) if exclude_self else df
    scored = lambda some, low: other(reduce(DataFrame.unionByName, [_flat_cosines(queries, some, n, low) for n in sizes]))
    path = scratch(spark, "low")  # written, so that no broadcast waits for it
    best = top_k(scored(database.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0), None), k)
    # ties are broken after rounding
    best.groupBy(F.col("query_id").alias("asked")).agg(F.count(F.lit(1)).alias("n"), (F.min("score") - 2 * 10.0**-DIGITS).alias("low")).where(F.col("n") >= k).select("asked", "low").write.parquet(path)
    return top_k(scored(database, spark.read.schema(f"asked {queries.schema['id'].dataType.simpleString()}, low double").parquet(path)), k)


def top_k(scores: DataFrame, k: int, strict: bool = False, database_rows: int | None = None) -> DataFrame:
    """(query_id, rank, db_id, score): the ``k`` largest scores of each query, ties by db_id. NaN and null scores are
    never taken. ``strict`` raises if k exceeds ``database_rows``."""
    if strict and database_rows is not None and k > database_rows:
        raise ValueError(f"k={k} exceeds the {database_rows} rows of the database")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "db_id")
    kept = scores.where(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.select("query_id", "rank", "db_id", "score")


def _block_top_k(database: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int, exclude_self: bool, kinds: tuple[str, str], pa_query, unit: bool = True) -> DataFrame:
    """The k best of each Arrow batch for one block of queries."""
    sent = database.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, q = sent.value
        for batch in batches:
            column = batch.column(1)
            size = q.shape[1]
            fits = np.fromiter((n == size for n in column.value_lengths().fill_null(-1).to_pylist()), bool, batch.num_rows)
            if not fits.any():
                continue
            kept = batch.filter(pa.array(fits))
            values = kept.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            values = _unit(values) if unit else values
            db = kept.column(0)
            names = np.array(db.to_pylist(), object)
            for part in _slices(len(q), len(values)):
                own = own_ids[part]
                s = q[part] @ values.T
                s[np.isnan(s)] = -np.inf
                if exclude_self:
                    s[own[:, None] == names[None, :]] = -np.inf
                n = min(k, s.shape[1])
                limit = -np.partition(-s, n - 1, axis=1)[:, n - 1]
                # all that may tie with the last when rounded; the final cut decides
                row, at = np.nonzero((s >= limit[:, None] - 2 * 10.0**-DIGITS) & (s > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(own[row].tolist(), pa_query), db.take(pa.array(at)), pa.array(_pair_scores(q[part], values, row, at))], names=["query_id", "db_id", "score"])

    return database.mapInArrow(run, f"query_id {kinds[0]}, db_id {kinds[1]}, score double")


def search(queries: DataFrame, database: DataFrame, k: int = 10, strategy: str = "auto", exclude_self: bool = False, strict: bool = False, block_values: int = _BLOCK_VALUES, unit: bool = True) -> DataFrame:
    """(query_id, rank, db_id, score): the ``k`` nearest database rows of each query by cosine, ties by db_id. ``unit=False``
    takes plain dot products (blocks alone).

    Both inputs have columns id and embedding. Null vectors, vectors of another length and NaN scores are never
    hits; ``exclude_self`` leaves out the row whose id equals the query's; ``strict`` raises if the database has fewer
    than k rows. Query ids should be unique: rows that share one share its k places."""
    queries, database = queries.select("id", "embedding"), database.select("id", "embedding")
    kinds = (queries.schema["id"].dataType.simpleString(), database.schema["id"].dataType.simpleString())
    if strategy not in ("auto", "native", "blocks"):
        raise ValueError(f"no strategy {strategy!r}")
    # rows of each partition that has some
    held = [r[1] for r in database.groupBy(F.spark_partition_id()).count().collect()] if strict or strategy != "blocks" else []
    rows = sum(held)
    if strict and k > rows:
        raise ValueError(f"k={k} exceeds the {rows} rows of the database")
    if strategy == "auto":
        strategy = "blocks" if rows * queries.count() > _NATIVE_PAIRS else "native"
    known = queries.where("embedding is not null")
    blocks = _blocks(known, block_values)
    if strategy == "native":
        sizes = [r.n for r in known.select(F.size("embedding").alias("n")).distinct().limit(_FLAT_SIZES + 1).collect()]
        many = 0 < len(sizes) <= _FLAT_SIZES and 0 < min(sizes) <= max(sizes) <= _FLAT_SIZE and rows * known.count() > _NATIVE_PAIRS
        # tasks of many pairs are several a core, so that none is waited for long
        database = _spread(database, len(held), 4) if many else _spread(database, len(held))

        def best(part: DataFrame) -> DataFrame:
            if many:
                return _native_top_k(part, database, rows, k, sizes, exclude_self)
            scores = _native_cosines(part, database)
            if exclude_self:
                scores = scores.where(~F.col("query_id").eqNullSafe(F.col("db_id")))
            return top_k(scores, k)

    else:
        kind = to_arrow_type(queries.schema["id"].dataType)

        def best(part: DataFrame) -> DataFrame:
            sizes = [_block_top_k(database, ids, matrix, k, exclude_self, kinds, kind, unit) for ids, matrix in _matrices(part, unit).values()]
            if not sizes:
                return top_k(cosine_scores(part, database, 2**62), k)
            return top_k(reduce(DataFrame.unionByName, sizes), k)

    # a query is in one block, so each block's best are final
    return one_by_one((best(p) for p in _parts(known, blocks)), blocks > 1)


def _matrices(queries: DataFrame, unit: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Query vectors by length, as unit vectors or as they are; at most one block's worth comes to the driver."""
    by: dict[int, tuple[list, list]] = {}
    for r in queries.orderBy("id").collect():
        ids, rows = by.setdefault(len(r.embedding), ([], []))
        ids.append(r.id)
        rows.append(r.embedding)
    out = {}
    for size, (ids, rows) in by.items():
        m = np.array(rows, np.float64).reshape(len(rows), size)
        held = np.empty(len(ids), object)
        held[:] = ids
        out[size] = (held, _unit(m) if unit else m)
    return out


def gather(hits: DataFrame, database: DataFrame) -> DataFrame:
    """``hits`` with the embedding of each candidate, by an equi-join on the id; candidates that the database lacks
    have no row."""
    return hits.join(database.select(F.col("id").alias("db_id"), "embedding"), "db_id")
