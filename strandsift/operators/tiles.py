"""Local alignment of long sequences in tiles, whose borders go from task to task.

The table of the dynamic programme is cut into squares. A tile needs the last row above it (H and the gaps that come down,
E), the last column to its left (H and the gaps that come along, F) and the corner between; so all tiles of an
antidiagonal, of all pairs, are computed at once, each in its own task's memory, and send their own borders to the next
antidiagonal. A task holds a few tiles' letters and borders, whatever the lengths. Borders are written to the shared folder
after each antidiagonal, so a lost executor costs one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandsift.functions.substitution import SubstitutionMatrix, parity
from strandsift.sources.shared import scratch

#: Of a border beyond the table: no gap can come from there.
NO_GAP = -(1 << 29)
_TILES_A_TASK = 16


def codes(seq: str) -> np.ndarray:
    """Letters as 0 to 25, all else as 26."""
    raw = np.frombuffer(seq.encode("ascii", "replace"), np.uint8).astype(np.int16) - 65
    return np.where((raw < 0) | (raw > 25), 26, raw)


class Borders:
    """What enters or leaves a tile: the row ``h`` and ``gap`` above it, the column ``h`` and ``gap`` left of it, and the
    corner between."""

    def __init__(self, above: np.ndarray, down: np.ndarray, left: np.ndarray, along: np.ndarray, corner: int = 0):
        self.above, self.down, self.left, self.along, self.corner = above, down, left, along, corner

    @classmethod
    def outer(cls, rows: int, columns: int) -> Borders:
        zero, none = (lambda n: np.zeros(n, np.int32)), (lambda n: np.full(n, NO_GAP, np.int32))
        return cls(zero(columns), none(columns), zero(rows), none(rows))


def tile(query: np.ndarray, target: np.ndarray, given: Borders, dense: np.ndarray, gap_open: int, gap_extend: int) -> tuple[Borders, tuple[int, int, int]]:
    """(borders that leave, (score, row, column)) of one tile of codes: its last row in ``above`` and ``down``, its last
    column in ``left`` and ``along``; the best score with the first place that has it, rows first."""
    extend = min(gap_open, gap_extend)
    n, m = len(query), len(target)
    score = dense.astype(np.int32)
    profile = {c: score[c][target] for c in np.unique(query).tolist()}
    slope = np.arange(m, dtype=np.int32) * extend
    back = slope + (gap_open - extend)
    h, e = given.above.copy(), given.down.copy()
    t, reach, f = np.empty(m, np.int32), np.empty(m + 1, np.int32), np.empty(m, np.int32)
    left, along = np.empty(n, np.int32), np.empty(n, np.int32)
    best, at = 0, (0, 0)
    before = given.corner
    own_left, own_along = given.left.tolist(), given.along.tolist()
    for r, c in enumerate(query.tolist()):
        np.maximum(e - extend, h - gap_open, out=e)
        s = profile[c]
        t[0] = before + s[0]
        np.add(h[:-1], s[1:], out=t[1:])
        np.maximum(t, e, out=t)
        np.maximum(t, 0, out=t)
        # the gap that enters from the left counts as one that was opened before the first column
        reach[0] = max(own_along[r] - extend, own_left[r] - gap_open) + gap_open - extend
        np.add(t, slope, out=reach[1:])
        np.maximum.accumulate(reach, out=reach)
        np.subtract(reach[:-1], back, out=f)
        np.maximum(t, f, out=h)
        before = own_left[r]
        left[r], along[r] = h[-1], f[-1]
        most = int(h.max())
        if most > best:
            best, at = most, (r, int(h.argmax()))
    return Borders(h, e, left, along), (best, *at)


def pieces(sequences: DataFrame, size: int, names: tuple[str, str, str]) -> DataFrame:
    """Sequences (id, seq) in pieces of ``size`` letters, numbered from 0, written to the shared folder."""
    ends = F.transform(F.sequence(F.lit(0), F.expr(f"cast((length(seq) - 1) div {size} as int)")), lambda k: F.substring(F.col("seq"), k * size + 1, F.lit(size)))
    path = scratch(sequences.sparkSession, "pieces")
    sequences.where("seq <> ''").select("id", F.posexplode(ends)).toDF(*names).write.parquet(path)
    return sequences.sparkSession.read.parquet(path)


def align_tiled(pairs: DataFrame, queries: DataFrame, database: DataFrame, matrix: SubstitutionMatrix | None = None, gap_open: int = 11, gap_extend: int = 1, size: int = 16_384) -> DataFrame:
    """(query_id, db_id, sw_score, query_end, db_end) of the listed pairs, of sequences of any length: the score and the
    first place, from 0, rows first, where an alignment of that score ends (null if the score is 0).

    ``queries`` and ``database`` have columns id (unique) and seq. Pairs with a null or empty sequence, or with an id that is
    not there, have no row; a repeated pair has one. ``size``: letters on a tile's side. An antidiagonal of tiles of all pairs
    is one job, so there are as many as the longest pair has tiles along both sides."""
    spark, dense = pairs.sparkSession, (matrix or parity()).dense
    q, d = pieces(queries.select("id", "seq"), size, ("query_id", "i", "query_piece")), pieces(database.select("id", "seq"), size, ("db_id", "j", "db_piece"))
    count = lambda x, key, name: x.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias(name))
    ids = pairs.select("query_id", "db_id").distinct().join(count(q, "query_id", "rows"), "query_id").join(count(d, "db_id", "columns"), "db_id")
    kinds = [ids.schema[c].dataType for c in ("query_id", "db_id")]
    arrow = [to_arrow_type(k) for k in kinds]
    border = "h binary, gap binary, corner int"
    whole = f"query_id {kinds[0].simpleString()}, db_id {kinds[1].simpleString()}, rows int, columns int, i int, j int, above struct<{border}>, left struct<{border}>, score int, query_end long, db_end long"
    schema = pa.schema([("query_id", arrow[0]), ("db_id", arrow[1]), *((c, pa.int32()) for c in ("rows", "columns", "i", "j")), *((c, pa.struct([("h", pa.binary()), ("gap", pa.binary()), ("corner", pa.int32())])) for c in ("above", "left")), ("score", pa.int32()), ("query_end", pa.int64()), ("db_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                own, other = codes(x["query_piece"]), codes(x["db_piece"])
                given = Borders.outer(len(own), len(other))
                read = lambda b: np.frombuffer(b, np.int32)
                if x["above"]:
                    given.above, given.down, given.corner = read(x["above"]["h"]), read(x["above"]["gap"]), x["above"]["corner"]
                if x["left"]:
                    given.left, given.along = read(x["left"]["h"]), read(x["left"]["gap"])
                left, (score, row, column) = tile(own, other, given, dense, gap_open, gap_extend)
                found = (score, x["i"] * size + row, x["j"] * size + column)
                if x["score"]:
                    found = min(found, (x["score"], x["query_end"], x["db_end"]), key=lambda f: (-f[0], *f[1:]))
                best = {"score": found[0], "query_end": found[1] if found[0] else None, "db_end": found[2] if found[0] else None}
                common = {c: x[c] for c in ("query_id", "db_id", "rows", "columns")}
                corner = int(given.left[-1])  # of the tile to the right of the one below
                down = {"h": left.above.tobytes(), "gap": left.down.tobytes(), "corner": corner}
                along = {"h": left.left.tobytes(), "gap": left.along.tobytes(), "corner": 0}
                sent = []
                if x["i"] + 1 < x["rows"]:
                    sent.append(common | {"i": x["i"] + 1, "j": x["j"], "above": down, "left": None} | best)
                if x["j"] + 1 < x["columns"]:
                    sent.append(common | {"i": x["i"], "j": x["j"] + 1, "above": None, "left": along} | best)
                yield pa.RecordBatch.from_pylist(sent or [common | {"i": x["rows"], "j": x["columns"], "above": None, "left": None} | best], schema=schema)

    done = None
    none = F.lit(None)
    now = ids.withColumns({"i": F.lit(0), "j": F.lit(0), "above": none.cast(f"struct<{border}>"), "left": none.cast(f"struct<{border}>"), "score": F.lit(0), "query_end": none.cast("long"), "db_end": none.cast("long")})
    tiles, path = ids.count(), None
    while tiles:
        tasks = max(min(tiles, spark.sparkContext.defaultParallelism), -(-tiles // _TILES_A_TASK))
        met = now.join(q, ["query_id", "i"]).join(d, ["db_id", "j"]).select("query_id", "db_id", "rows", "columns", "i", "j", "above", "left", "score", "query_end", "db_end", "query_piece", "db_piece")
        path = scratch(spark, "antidiagonal")
        met.repartition(tasks).mapInArrow(run, whole).write.parquet(path)
        sent = spark.read.schema(whole).parquet(path)
        ended = sent.where("i = rows and j = columns").select("query_id", "db_id", F.col("score").alias("sw_score"), "query_end", "db_end")
        done = ended if done is None else done.unionByName(ended)
        better = F.min(F.struct((-F.col("score")).alias("score"), "query_end", "db_end"))
        now = sent.where("not (i = rows and j = columns)").groupBy("query_id", "db_id", "rows", "columns", "i", "j").agg(F.first("above", True).alias("above"), F.first("left", True).alias("left"), better.alias("best"))
        now = now.select("query_id", "db_id", "rows", "columns", "i", "j", "above", "left", (-F.col("best.score")).alias("score"), "best.query_end", "best.db_end")
        tiles = now.select("i").count()
    if done is None:
        return ids.select("query_id", "db_id", F.lit(0).alias("sw_score"), none.cast("long").alias("query_end"), none.cast("long").alias("db_end"))
    return done
