"""Local alignment with affine gaps (Smith-Waterman), vectorised over queries and the database sequences of a batch.

A block of queries, one after another, and of database sequences of like length, side by side, goes through the dynamic
programme by antidiagonals, in 16-bit cells that stay in a core's cache. A gap of length L costs open + (L - 1) * extend; if
extending costs more than opening, opening again is cheaper, so the smaller of the two extends. Long sequences are cut
into tiles (operators/tiles.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandsift.functions.substitution import SubstitutionMatrix, parity
from strandsift.operators.tiles import align_tiled
from strandsift.sources.shared import one_by_one, scratch

#: The score of a pair with a sequence longer than the limit.
TOO_LONG = -1_000_000_000
MAX_LENGTH = 1024
#: Cells of an antidiagonal of a block: what is updated at once stays in a core's cache.
_CELLS = 1 << 16
_FEW_CELLS = 1 << 13
#: Antidiagonals whose substitution scores are laid out at once.
_STEPS = 1024
#: Ids of hits that are named in a plan at most.
_FEW_IDS = 1000
#: Rows that one Arrow batch of scores has at most, or one sequence's.
_OUT_ROWS = 1 << 18
#: Letters of queries that are aligned in one pass.
_ROWS = 2048
#: Letters of a text beyond which it is aligned in pieces.
_BODY = 8192
#: A score below that of any alignment; 16-bit cells hold it beside scores of as much.
_NEVER = -16_000


def _codes(seq: str) -> np.ndarray:
    raw = np.frombuffer(seq.encode("ascii", "replace"), np.uint8).astype(np.int16) - 65
    return np.where((raw < 0) | (raw > 25), 26, raw).astype(np.uint8)


def scores(query: str, database: list[str], matrix: SubstitutionMatrix, gap_open: int = 11, gap_extend: int = 1) -> np.ndarray:
    """The best local alignment score of ``query`` with each sequence."""
    return scores_many([query], database, matrix, gap_open, gap_extend)[0]


def scores_many(queries: list[str], database: list[str], matrix: SubstitutionMatrix, gap_open: int = 11, gap_extend: int = 1) -> np.ndarray:
    """(queries, sequences): the best local alignment score of each query with each sequence. Equal sequences are aligned once."""
    place = {x: i for i, x in enumerate(dict.fromkeys(database))}
    distinct = sorted(place, key=len)
    out = np.zeros((len(queries), len(distinct)), np.int64)
    begin = 0
    while begin < len(queries):
        end, rows = begin + 1, len(queries[begin]) + 1
        while end < len(queries) and rows + len(queries[end]) + 1 <= _ROWS:
            rows += len(queries[end]) + 1
            end += 1
        if rows > end - begin:
            lanes = max(8, _CELLS // rows)
            own = [_codes(q) for q in queries[begin:end]]
            extend = min(gap_open, gap_extend)
            texts, of = _pieces(distinct, max(_span(q, matrix.dense, gap_open, extend) for q in own))
            longest, at = max(map(len, own)), 0
            while at < len(texts):
                stop = at + 1
                # of like length, as all lanes go as far as the longest; but not so few that calls cost more than cells
                while stop < min(at + lanes, len(texts)) and ((stop - at) * rows < _FEW_CELLS or 4 * (len(texts[stop]) + longest) <= 5 * (len(texts[at]) + longest)):
                    stop += 1
                np.maximum.at(out[begin:end], (slice(None), of[at:stop]), _block(own, texts[at:stop], matrix.dense, gap_open, extend))
                at = stop
        begin = end
    order = {x: i for i, x in enumerate(distinct)}
    return out[:, [order[x] for x in database]] if database else out


def _span(query: np.ndarray, dense: np.ndarray, gap_open: int, extend: int) -> int:
    """Letters that an alignment of a positive score may reach over: its gaps cost less than its letters bring."""
    if extend <= 0:
        return 1 << 62
    gain = int(np.maximum(dense.max(1), 0)[query].sum())
    return len(query) + max(0, (gain - gap_open) // extend + 1)


def _pieces(texts: list[str], span: int) -> tuple[list[str], np.ndarray]:
    """Long texts in pieces that overlap by ``span``, so that each alignment lies in one; shortest first, and whose they are."""
    body = max(_BODY, 4 * span)
    cut = [(x[k : k + body + span], i) for i, x in enumerate(texts) for k in range(0, max(1, len(x) - span), body)]
    cut.sort(key=lambda c: len(c[0]))
    return [x for x, _ in cut], np.array([i for _, i in cut], np.int64)


def _block(queries: list[np.ndarray], database: list[str], dense: np.ndarray, gap_open: int, extend: int) -> np.ndarray:
    """The best scores of some queries with sequences of like length, antidiagonal by antidiagonal: a cell's neighbours are
    on the two before, so that all cells of one, of all pairs, are updated at once."""
    lanes, width = len(database), len(database[-1])
    longest = max(map(len, queries))
    if not width or not longest:
        return np.zeros((len(queries), lanes), np.int64)
    small = longest * max(int(dense.max()), 1) < -_NEVER and abs(gap_open) + abs(extend) < 8_000 and int(dense.min()) > _NEVER
    kind, never = (np.int16, _NEVER) if small else (np.int32, -(1 << 29))
    # a row of zeros before each query, which its first letter has above it
    letter = np.concatenate([np.append(np.uint8(28), q) for q in queries])
    skew = np.concatenate([np.arange(len(q) + 1) for q in queries])
    breaks = np.flatnonzero(letter == 28)
    text = np.full((longest + width + longest, lanes), 27, np.uint8)  # code 27 pads and never aligns
    for lane, seq in enumerate(database):
        text[longest : longest + len(seq), lane] = _codes(seq)
    padded = np.full((29, 28), never, kind)
    padded[:27, :27] = dense
    used, which = np.unique(letter, return_inverse=True)
    h, before, fresh = (np.zeros((len(letter), lanes), kind) for _ in range(3))
    opened = np.full_like(h, -gap_open)
    down, along, best = opened.copy(), opened.copy(), np.zeros_like(h)
    met, moved, zero = np.empty_like(h), np.empty_like(h), np.zeros_like(h)
    above = {id(x): [x[i] for i in breaks] for x in (h, before, fresh, down)}
    steps = width + longest
    for first in range(0, steps, _STEPS):
        n = min(_STEPS, steps - first)
        # row i of antidiagonal s has the letter s - skew, of which the first is number 1
        window = text[first : first + n + longest]
        laid = padded[used][:, window].reshape(-1, lanes)
        base = which * len(window) + longest - skew
        for s in range(n):
            np.take(laid, base + s, axis=0, out=met, mode="clip")
            np.subtract(down[:-1], extend, out=moved[1:])
            np.maximum(moved[1:], opened[:-1], out=down[1:])
            np.subtract(along, extend, out=along)
            np.maximum(along, opened, out=along)
            np.add(met[1:], before[:-1], out=fresh[1:])
            np.maximum(fresh[1:], down[1:], out=fresh[1:])
            np.maximum(fresh, along, out=fresh)
            np.maximum(fresh, zero, out=fresh)
            for row in above[id(fresh)]:
                row.fill(0)
            for row in above[id(down)]:
                row.fill(-gap_open)
            np.maximum(best, fresh, out=best)
            np.subtract(fresh, gap_open, out=opened)
            before, h, fresh = h, fresh, before
    return np.maximum.reduceat(best, breaks, axis=0).astype(np.int64)


def align_pairs(pairs: DataFrame, query: str = "query_seq", target: str = "db_seq", output: str = "sw_score", matrix: SubstitutionMatrix | None = None, gap_open: int = 11, gap_extend: int = 1, max_length: int | None = MAX_LENGTH) -> DataFrame:
    """``pairs`` with an integer column ``output``, the alignment score of the two sequences of each row.

    A sequence longer than ``max_length`` gives TOO_LONG (None: no limit); a null sequence gives null; an empty one
    scores 0. Rows are scored in Arrow batches, those of one query together."""
    matrix = matrix or parity()
    columns = [c for c in pairs.columns if c != output]
    schema = pairs.select(columns).schema.add(output, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, d = batch.column(columns.index(query)).to_pylist(), batch.column(columns.index(target)).to_pylist()
            result: list[int | None] = [None] * len(q)
            by: dict[str, list[int]] = {}
            for i, (a, b) in enumerate(zip(q, d, strict=True)):
                if a is None or b is None:
                    continue
                if max_length is not None and (len(a) > max_length or len(b) > max_length):
                    result[i] = TOO_LONG
                else:
                    by.setdefault(a, []).append(i)
            for a, rows in by.items():
                for i, s in zip(rows, scores(a, [d[i] for i in rows], matrix, gap_open, gap_extend).tolist(), strict=True):
                    result[i] = s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.int32())], names=[*columns, output])

    return pairs.select(columns).mapInArrow(run, schema)


#: Letters of a sequence beyond which its pairs are aligned in tiles.
LONG = 1 << 17


def _is_long(long: int) -> Column:
    return F.coalesce(F.length("seq") > long, F.lit(False))


def any_long(long: int, *sides: DataFrame) -> bool:
    """Whether a side has a sequence of more than ``long`` letters."""
    return any((s.agg(F.max(F.length("seq"))).first()[0] or 0) > long for s in sides)


def _in_tiles(pairs: DataFrame, queries: DataFrame, database: DataFrame, options: dict) -> DataFrame:
    """(query_id, db_id, sw_score) of pairs with a long sequence. The other one may be null or empty."""
    chosen = {k: options[k] for k in ("matrix", "gap_open", "gap_extend") if k in options}
    scored = align_tiled(pairs, queries, database, **chosen).select("query_id", "db_id", "sw_score")
    known = lambda df, key: df.select(F.col("id").alias(key), F.col("seq").isNull().alias(f"_{key}"))
    met = pairs.join(known(queries, "query_id"), "query_id").join(known(database, "db_id"), "db_id").join(scored, ["query_id", "db_id"], "left")
    return met.select("query_id", "db_id", F.when(F.col("_query_id") | F.col("_db_id"), F.lit(None)).otherwise(F.coalesce("sw_score", F.lit(0))).cast("int").alias("sw_score"))


def align_all(queries: DataFrame, database: DataFrame, block_rows: int = 2000, long: int = LONG, **options) -> DataFrame:
    """(query_id, db_id, sw_score) of every query with every database row. Both have columns id and seq.

    The queries come in blocks of at most ``block_rows``, broadcast one block after another. Without a limit of length,
    sequences of more than ``long`` letters, whose ids must be unique, are aligned in tiles instead."""
    if options.get("max_length", MAX_LENGTH) is None and any_long(long, queries, database):
        ids = lambda df, key: df.where(_is_long(long)).select(F.col("id").alias(key))
        every = lambda df, key: df.select(F.col("id").alias(key))
        # long sequences are few; pairs of ids alone
        pairs = ids(queries, "query_id").crossJoin(every(database, "db_id")).unionByName(every(queries.where(~_is_long(long)), "query_id").crossJoin(ids(database, "db_id")))
        rest = align_all(queries.where(~_is_long(long)), database.where(~_is_long(long)), block_rows, long, **options)
        return rest.unionByName(_in_tiles(pairs, queries, database, options))
    # by id, so that a small table is not one task's; at any size the alignments cost far more than this shuffle
    queries, database = queries.select("id", "seq"), database.select("id", "seq").repartition("id")
    blocks = max(1, -(-queries.count() // block_rows))
    parts = (queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries for b in range(blocks))
    return one_by_one((_align_block(part, database, **options) for part in parts), blocks > 1)


def _align_block(queries: DataFrame, database: DataFrame, matrix: SubstitutionMatrix | None = None, gap_open: int = 11, gap_extend: int = 1, max_length: int | None = MAX_LENGTH) -> DataFrame:
    """One block of queries with all rows, whose texts are sent to Python once, not once a query."""
    rows = queries.collect()
    sent = queries.sparkSession.sparkContext.broadcast(([r.id for r in rows], [r.seq for r in rows], matrix or parity()))
    kinds = [x.schema["id"].dataType for x in (queries, database)]
    id_type = to_arrow_type(kinds[0])
    fits = lambda seq: seq is not None and (max_length is None or len(seq) <= max_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, table = sent.value
        own = [i for i, q in enumerate(asked) if fits(q)]
        step = max(1, _OUT_ROWS // max(1, len(ids)))
        for whole in batches if ids else ():
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                texts = batch.column(1).to_pylist()
                good = [i for i, x in enumerate(texts) if fits(x)]
                out = np.full((len(ids), len(texts)), TOO_LONG, np.int32)
                out[np.ix_(own, good)] = scores_many([asked[i] for i in own], [texts[i] for i in good], table, gap_open, gap_extend)
                unknown = np.zeros(out.shape, bool)
                unknown[[i for i, q in enumerate(asked) if q is None]] = True
                unknown[:, [i for i, x in enumerate(texts) if x is None]] = True
                every = pa.array(np.repeat(np.arange(len(ids)), len(texts)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(every), batch.column(0).take(pa.array(np.tile(np.arange(len(texts)), len(ids)))), pa.array(out.ravel(), pa.int32(), mask=unknown.ravel())], names=["query_id", "db_id", "sw_score"])

    return database.mapInArrow(run, f"query_id {kinds[0].simpleString()}, db_id {kinds[1].simpleString()}, sw_score int")


def align_listed(pairs: DataFrame, queries: DataFrame, database: DataFrame, long: int = LONG, **options) -> DataFrame:
    """(query_id, db_id, sw_score) of an explicit list of pairs (query_id, db_id): two equi-joins, then the aligner. Without
    a limit of length, pairs with a sequence of more than ``long`` letters, whose ids must be unique, are aligned in tiles."""
    side = lambda df, key, name: df.select(F.col("id").alias(key), F.col("seq").alias(name))
    pairs = pairs.select("query_id", "db_id")
    met = pairs.join(side(queries, "query_id", "query_seq"), "query_id").join(side(database, "db_id", "db_seq"), "db_id")
    if options.get("max_length", MAX_LENGTH) is None and any_long(long, queries, database):
        beyond = F.coalesce(F.greatest(F.length("query_seq"), F.length("db_seq")) > long, F.lit(False))
        rest = align_pairs(met.where(~beyond), **options).select("query_id", "db_id", "sw_score")
        return rest.unionByName(_in_tiles(met.where(beyond).select("query_id", "db_id"), queries, database, options))
    return align_pairs(met, **options).select("query_id", "db_id", "sw_score")


def rerank(hits: DataFrame, queries: DataFrame, database: DataFrame, **options) -> DataFrame:
    """``hits`` (query_id, rank, db_id, score) ranked anew by alignment score, then the old score, then the id:
    (query_id, rank, db_id, score, sw_score, first_rank)."""
    spark, path = hits.sparkSession, scratch(hits.sparkSession, "hits")
    hits.write.parquet(path)  # read several times, and what found them is the dearest part
    hits = spark.read.schema(hits.schema).parquet(path)
    found = [r.db_id for r in hits.select("db_id").distinct().limit(_FEW_IDS + 1).collect()]
    # few ids are a filter that reaches the scan, so that no other row's sequence is made
    database = database.where(F.col("id").isin(found)) if len(found) <= _FEW_IDS else database.join(hits.select(F.col("db_id").alias("id")).distinct(), "id", "left_semi")
    scored = align_listed(hits, queries, database, **options)
    order = Window.partitionBy("query_id").orderBy(F.desc("sw_score"), F.desc("score"), "db_id")
    met = hits.withColumnRenamed("rank", "first_rank").join(scored, ["query_id", "db_id"])
    return met.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "db_id", "score", "sw_score", "first_rank")


def substitution_score(a: Column, b: Column, matrix: SubstitutionMatrix | None = None) -> Column:
    """The matrix score of two residues as an expression; MISSING for letters that it lacks."""
    matrix = matrix or parity()
    table = F.array(*[F.lit(int(x)) for x in matrix.table.ravel()])
    i, j = F.instr(F.lit(matrix.letters), a) - 1, F.instr(F.lit(matrix.letters), b) - 1
    known = (F.length(a) == 1) & (F.length(b) == 1) & (i >= 0) & (j >= 0)
    return F.when(known, F.get(table, i * len(matrix.letters) + j)).otherwise(F.lit(-4))
