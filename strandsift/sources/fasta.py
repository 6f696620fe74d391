"""FASTA through Spark's own text reader, so that any store that Spark reads will do and large files are read in
parallel.

Lines are numbered by split and place; each split counts its headers, and a prefix sum over the splits of a file
numbers the records. A record's lines are then joined in order, also where a record crosses splits. Compressed files
are one split each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandsift.functions import sequence
from strandsift.sources.shared import scratch

_STRIP = r"(?U)^\s+|\s+$"


def read_fasta(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """(path, seq_no, id, seq): one row per record; seq_no counts from 0 in each file.

    Lines are stripped and blank ones skipped; '>' starts a record whose id is the next word; other lines are upper-cased
    and joined; lines before the first header are dropped; a record without lines has an empty sequence. A header
    without a word raises, or gives a null id with mode 'PERMISSIVE'."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    raw = spark.read.text(path).select(F.regexp_replace("value", _STRIP, "").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = raw.where("line <> ''").withColumn("header", F.col("line").startswith(">").cast("long"))
    counts = lines.groupBy("path", "block").agg(F.sum("header").alias("headers"))
    before = counts.select("path", "block", (F.sum("headers").over(Window.partitionBy("path").orderBy("block")) - F.col("headers")).alias("before"))
    own = lines.withColumn("own", F.sum("header").over(Window.partitionBy("path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    numbered = own.join(before, ["path", "block"]).withColumn("record", F.col("own") + F.col("before")).where("record > 0")
    body = F.collect_list(F.when(F.col("header") == 0, F.struct("block", "place", F.upper("line").alias("line"))))
    records = numbered.groupBy("path", "record").agg(F.max(F.when(F.col("header") == 1, F.col("line"))).alias("header"), F.array_join(F.transform(F.array_sort(body), lambda x: x["line"]), "").alias("seq"))
    name = sequence.header_id(F.col("header"))
    if mode == "FAILFAST":
        name = F.when(name.isNotNull(), name).otherwise(F.raise_error(F.concat(F.lit("a header without an id in "), F.col("path"))).cast("string"))
    return records.select("path", (F.col("record") - 1).alias("seq_no"), name.alias("id"), "seq")


def write_fasta(df: DataFrame, path: str, width: int = 80, order: str | None = "seq_no", mode: str = "overwrite", compression: str | None = None) -> None:
    """``df`` (id, seq) as FASTA files in the folder ``path``; an empty or null sequence is a header alone."""
    if order is not None and order in df.columns:
        df = df.orderBy(order)
    body = F.when(F.coalesce(F.col("seq"), F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("\n"), sequence.wrap(F.col("seq"), width)))
    writer = df.select(F.concat(F.lit(">"), F.col("id").cast("string"), body).alias("value")).write.mode(mode)
    (writer.option("compression", compression) if compression else writer).text(path)


def filter_fasta(df: DataFrame, min_len: int = 0, max_len: int | None = None, valid_chars: str = sequence.ALPHABET) -> DataFrame:
    """Records whose length lies between the bounds, inclusive, and whose characters are all valid."""
    return df.where(sequence.length_between(F.col("seq"), min_len, max_len) & sequence.is_valid(F.col("seq"), valid_chars))


def fasta_stats(df: DataFrame) -> DataFrame:
    """One row: count, min_len, max_len, mean_len, total_residues; all but count are null for no record."""
    n = F.length("seq")
    return df.agg(F.count(F.lit(1)).alias("count"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"), F.sum(n).cast("long").alias("total_residues"))


def load_sequences(spark: SparkSession, path: str, max_seqs: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Cleaned, non-empty records in file order, the first ``max_seqs`` of them (None or 0: all)."""
    from strandsift.operators.split import first_rows

    df = read_fasta(spark, path, mode).withColumn("seq", sequence.clean(F.col("seq"))).where("seq <> ''")
    return first_rows(df, max_seqs)


def sequence_dataset(spark: SparkSession, path: str, max_len: int = 1024) -> DataFrame:
    """(seq_no, id, seq, codes): cleaned records with their codes cut or padded to ``max_len``."""
    return load_sequences(spark, path).select("seq_no", "id", "seq", sequence.encode(F.col("seq"), max_len).alias("codes"))


def family_dataset(spark: SparkSession, folder: str, split: str | None = None, max_len: int | None = 1024) -> DataFrame:
    """(family, split, label, seq_no, id, seq, codes) of ``folder/<family>/{train,test,dev}.fasta``, one split or all.
    Labels number the families by name."""
    from strandsift.operators.split import dense_label

    df = read_fasta(spark, f"{folder}/*/{split or '{train,test,dev}'}.fasta")
    df = df.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("family"), F.regexp_extract("path", r"([^/]+)\.fasta$", 1).alias("split"), "seq_no", "id", sequence.clean(F.col("seq")).alias("seq")).where("seq <> ''")
    return dense_label(df).withColumn("codes", sequence.encode(F.col("seq"), max_len))


def split_fasta(df: DataFrame, train: str, val: str, test: str, train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 42) -> None:
    """Writes the three parts of a seeded split as FASTA."""
    from strandsift.operators.split import three_way_split

    parts = three_way_split(df, train_ratio, val_ratio, seed)
    held = scratch(df.sparkSession, "split")  # in the shared folder, where a lost executor takes nothing with it
    parts.write.parquet(held)
    parts = df.sparkSession.read.schema(parts.schema).parquet(held)
    for name, path in (("train", train), ("val", val), ("test", test)):
        write_fasta(parts.where(F.col("split") == name), path)
