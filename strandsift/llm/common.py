"""What the training-data operators share: the cluster's shared folder, cutting lineage, and Arrow helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The session's setting rules; only where it is unset in
    local mode is a temporary folder made, and on a cluster that is an error."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if known is None:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="strandsift-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` as a compressed table in the shared folder, for wide rows that are read again. The folder's owner
    removes it with the rest of the checkpoints."""
    path = f"{ensure_shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A materialized ``df``, marked for broadcast if it has at most ``rows`` rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(row, file, index): ``docs`` as structs, and what tells its rows apart: file and place in a Parquet scan, else in
    a written copy."""
    row = F.struct("*").alias("row")
    if docs.inputFiles():
        with contextlib.suppress(AnalysisException):  # no plain scan
            return docs.select(row, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
    return stored(docs.select(row, F.lit("").alias("file"), F.monotonically_increasing_id().alias("index")))


#: Bits of a block of rows.
_BLOCK = 1 << 15


def marked(df: DataFrame, rows: DataFrame, place: str, keys: tuple[str, ...] = (), name: str = "marked") -> DataFrame:
    """``df`` with a boolean column ``name``: whether a row's ``place`` (a whole number) and ``keys`` are among ``rows``. These
    are sent as one bit a row, in blocks of 4 KB, so that ``df`` is not shuffled; beyond 20,000 blocks the join shuffles."""
    at = F.expr(place)
    bits = rows.groupBy(*keys, F.shiftright(at, 15).alias("_block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(_BLOCK - 1))).alias("_bits"))
    met = df.withColumn("_block", F.shiftright(at, 15)).join(small(materialize(bits), 20_000), [*keys, "_block"], "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at.bitwiseAND(F.lit(_BLOCK - 1)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn(name, F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))).drop("_block", "_bits")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows from now on, unless the session has a setting of its own: whole texts in
    batches of Spark's usual 10,000 rows take memory on both sides of each Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def first_by_hash(keys: DataFrame, column: str, rows: int) -> DataFrame:
    """The first ``rows`` distinct keys in the order of their hash. A bound on the hash, from their approximate number,
    leaves all but a few more of them where they are, so that no task sorts what grows with the table."""
    place = F.xxhash64(F.col(column).cast("string"))
    n = keys.agg(F.approx_count_distinct(column)).first()[0]
    if n > 2 * rows:
        keys = keys.where(place < F.lit(int(2**64 * 1.5 * rows / n) - 2**63))
    return keys.select(column).distinct().orderBy(place, column).limit(rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_remainder(column: str, divisor: int):
    """crc32 of the key as text, modulo ``divisor``: the folds that the queries hold out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def encoded(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column, b'' for null, without decoding to ``str``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if data is None:
        for _ in range(len(column)):
            yield b""
        return
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data)
    null = column.is_null().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield b"" if null and null[i] else bytes(view[ends[i] : ends[i + 1]])


def strings(column: pa.Array) -> list[str]:
    """The values of a string column, '' for null."""
    return [x or "" for x in column.to_pylist()]
