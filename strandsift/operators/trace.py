"""Which letters a local alignment puts together, in linear space.

A sweep forwards finds where the best alignment first ends, one backwards from there where it begins; between the two the
alignment is global, and is found by divide and conquer: sweeps from both ends meet in the middle row and tell where the
path crosses it. Only sub-problems of bounded size keep a table. The table function takes and yields Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandsift.functions.substitution import SubstitutionMatrix, parity
from strandsift.operators.tiles import NO_GAP, Borders, codes, tile

_CELLS = 1 << 16

#: (operation, letters): M pairs letters, I has letters of the query alone, D of the target alone.
Steps = list[tuple[str, int]]


class Path:
    """A global alignment of codes; a gap of L letters costs ``first`` + L * ``each``."""

    def __init__(self, dense: np.ndarray, gap_open: int, gap_extend: int, cells: int = _CELLS):
        self.score = dense.astype(np.int64)
        self.each = min(gap_open, gap_extend)
        self.first = gap_open - self.each
        self.cells = cells

    def _rows(self, q: np.ndarray, d: np.ndarray, begun: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(h, e, f) of each row of the table from row 0 on: the best, and the best that ends in a gap down or along. A gap
        down from the first corner costs ``begun`` to open."""
        n = len(d)
        slope = np.arange(n + 1, dtype=np.int64) * self.each
        h = np.concatenate([[0], -(self.first + slope[1:])])
        e = np.full(n + 1, NO_GAP, np.int64)
        e[0] = -begun
        yield h, e, np.concatenate([[NO_GAP], h[1:]])
        for r, c in enumerate(q.tolist(), 1):
            e = np.maximum(e, h - self.first) - self.each
            e[0] = -(begun + r * self.each)
            t = np.empty(n + 1, np.int64)
            t[0] = e[0]
            np.maximum(h[:-1] + self.score[c][d], e[1:], out=t[1:])
            f = np.full(n + 1, NO_GAP, np.int64)
            f[1:] = np.maximum.accumulate(t + slope)[:-1] - slope[1:] - self.first
            h = np.maximum(t, f)
            yield h, e, f

    def steps(self, q: np.ndarray, d: np.ndarray) -> Steps:
        """The cheapest way through ``q`` and ``d``, runs joined."""
        out: Steps = []
        todo = [(q, d, self.first, self.first)]
        while todo:
            job = todo.pop()
            for op, n in [job] if isinstance(job[0], str) else self._part(*job, todo):
                if n and out and out[-1][0] == op:
                    out[-1] = (op, out[-1][1] + n)
                elif n:
                    out.append((op, n))
        return out

    def _part(self, q: np.ndarray, d: np.ndarray, begun: int, ending: int, todo: list) -> Steps:
        """Steps of a small part; a large one is halved, its parts put on ``todo``. ``begun`` and ``ending``: what it costs to
        open a gap down at the first and at the last corner, nothing if one goes on there."""
        if not len(q):
            return [("D", len(d))]
        if not len(d):
            return [("I", len(q))]
        if len(q) == 1 or len(q) * len(d) <= self.cells:
            return self._table(q, d, begun, ending)
        middle = len(q) // 2
        for h, e, _ in self._rows(q[:middle], d, begun):
            pass
        for back_h, back_e, _ in self._rows(q[middle:][::-1], d[::-1], ending):
            pass
        through, gapped = h + back_h[::-1], e + back_e[::-1] + self.first
        a, b = int(through.argmax()), int(gapped.argmax())
        if through[a] >= gapped[b]:
            todo += [(q[middle:], d[a:], self.first, ending), (q[:middle], d[:a], begun, self.first)]
        else:
            todo += [(q[middle + 1 :], d[b:], 0, ending), ("I", 2), (q[: middle - 1], d[:b], begun, 0)]
        return []

    def _table(self, q: np.ndarray, d: np.ndarray, begun: int, ending: int) -> Steps:
        h, e, f = (np.stack(x) for x in zip(*self._rows(q, d, begun), strict=True))
        i, j = len(q), len(d)
        in_gap = "E" if e[i, j] + self.first - ending > h[i, j] else ""
        out: Steps = []
        while i or j:
            if not in_gap:
                in_gap = "E" if i and h[i, j] == e[i, j] else "F" if j and h[i, j] == f[i, j] else ""
            if in_gap == "E":
                out.append(("I", 1))
                i -= 1
                if j and e[i + 1, j] != e[i, j] - self.each:
                    in_gap = ""
            elif in_gap == "F":
                out.append(("D", 1))
                j -= 1
                if f[i, j + 1] != f[i, j] - self.each:
                    in_gap = ""
            else:
                out.append(("M", 1))
                i, j = i - 1, j - 1
        return out[::-1]


def spans(query: str, target: str, matrix: SubstitutionMatrix, gap_open: int = 11, gap_extend: int = 1, cells: int = _CELLS) -> tuple[int, list[tuple[str, int, int, int, int]]]:
    """(score, [(operation, query begin, query end, target begin, target end)]) of the best local alignment that ends
    first, ends exclusive, from 0; no spans if the score is 0."""
    q, d = codes(query), codes(target)
    if not len(q) or not len(d):
        return 0, []
    sweep = lambda a, b: tile(a, b, Borders.outer(len(a), len(b)), matrix.dense, gap_open, gap_extend)[1]
    score, row, column = sweep(q, d)
    if not score:
        return 0, []
    # no alignment within these prefixes has that score but those that end here, so the one found backwards begins here
    _, back, aside = sweep(q[: row + 1][::-1], d[: column + 1][::-1])
    i, j = row - back, column - aside
    out = []
    for op, n in Path(matrix.dense, gap_open, gap_extend, cells).steps(q[i : row + 1], d[j : column + 1]):
        a, b = (n if op != "D" else 0), (n if op != "I" else 0)
        out.append((op, i, i + a, j, j + b))
        i, j = i + a, j + b
    return score, out


def align_trace(pairs: DataFrame, queries: DataFrame, database: DataFrame, matrix: SubstitutionMatrix | None = None, gap_open: int = 11, gap_extend: int = 1) -> DataFrame:
    """(query_id, db_id, step, op, query_begin, query_end, db_begin, db_end): the spans of the best local alignment of each
    listed pair, in order, ``step`` from 0. M pairs letters, I has letters of the query alone, D of the database's sequence
    alone; ends are exclusive.

    A pair without a positive score, or with a null or empty sequence, or an id that is not there, has no spans; a repeated
    pair has them each time. Memory is in proportion to the lengths, time to their product."""
    matrix = matrix or parity()
    met = pairs.select("query_id", "db_id").join(queries.select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq")), "query_id").join(database.select(F.col("id").alias("db_id"), F.col("seq").alias("db_seq")), "db_id").where("query_seq <> '' and db_seq <> ''")
    kinds = [met.schema[c].dataType for c in ("query_id", "db_id")]
    schema = pa.schema([("query_id", to_arrow_type(kinds[0])), ("db_id", to_arrow_type(kinds[1])), ("step", pa.int32()), ("op", pa.string()), *((c, pa.int64()) for c in ("query_begin", "query_end", "db_begin", "db_end"))])

    class Trace:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            columns = [batch.column(c).to_pylist() for c in ("query_id", "db_id", "query_seq", "db_seq")]
            for query_id, db_id, query, target in zip(*columns, strict=True):
                _, found = spans(query, target, matrix, gap_open, gap_extend)
                if found:
                    yield pa.Table.from_pylist([dict(zip(schema.names, (query_id, db_id, k, *x), strict=True)) for k, x in enumerate(found)], schema=schema)

    returns = f"query_id {kinds[0].simpleString()}, db_id {kinds[1].simpleString()}, step int, op string, query_begin long, query_end long, db_begin long, db_end long"
    # the work per byte is far above a shuffle's; a small table would otherwise be one task's
    return F.arrow_udtf(Trace, returnType=returns)(met.repartition(met.sparkSession.sparkContext.defaultParallelism).asTable())


def rescored(traced: DataFrame, queries: DataFrame, database: DataFrame, matrix: SubstitutionMatrix | None = None, gap_open: int = 11, gap_extend: int = 1) -> DataFrame:
    """(query_id, db_id, sw_score): what the spans of align_trace are worth, letter by letter, as native expressions."""
    from strandsift.operators.align import substitution_score

    letters = traced.join(queries.select(F.col("id").alias("query_id"), F.col("seq").alias("query_seq")), "query_id").join(database.select(F.col("id").alias("db_id"), F.col("seq").alias("db_seq")), "db_id")
    length = F.greatest(F.col("query_end") - F.col("query_begin"), F.col("db_end") - F.col("db_begin")).cast("int")
    at = lambda c, begin, k: F.substring(F.col(c), F.col(begin).cast("int") + k + 1, F.lit(1))
    paired = F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0), lambda a, k: a + substitution_score(at("query_seq", "query_begin", k), at("db_seq", "db_begin", k), matrix))
    worth = F.when(F.col("op") == "M", paired).otherwise(-(F.lit(gap_open) + (length - 1) * F.lit(min(gap_open, gap_extend))))
    return letters.groupBy("query_id", "db_id").agg(F.sum(worth).cast("int").alias("sw_score"))
