"""Embeddings, hit lists and metrics as files."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_embeddings(df: DataFrame, path: str) -> None:
    """(id, embedding) and what else ``df`` has, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    """(row, id, embedding) of compressed numpy archives with arrays embeddings and sequence_ids. Files come through
    Spark's reader; pickled objects are refused, so ids must be a string array."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    ids, vectors = archive["sequence_ids"], archive["embeddings"]
                    import pandas as pd

                    for k in range(0, len(ids), 4096):
                        part = vectors[k : k + 4096].astype(np.float32)
                        yield pd.DataFrame({"row": np.arange(k, k + len(part)), "id": ids[k : k + 4096].astype(str), "embedding": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, id string, embedding array<float>")


def read_lists(spark: SparkSession, path: str, value: str = "db_id") -> DataFrame:
    """(query_id, rank, value) of a JSON file that holds a list of lists of whole numbers; empty lists give no row."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<bigint>>").alias("lists"))
    each = rows.select(F.posexplode("lists").alias("query_id", "own"))
    return each.select(F.col("query_id").cast("long").alias("query_id"), F.posexplode("own").alias("at", value)).select("query_id", (F.col("at") + 1).alias("rank"), value)


def read_list_ids(spark: SparkSession, path: str) -> DataFrame:
    """(query_id): every list's number, empty ones included."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<bigint>>").alias("lists"))
    return rows.select(F.posexplode("lists").alias("query_id", "own")).select(F.col("query_id").cast("long").alias("query_id"))


def save_metrics(metrics: DataFrame, path: str) -> None:
    """(metric, value) as one JSON object in the folder ``path``."""
    pairs = F.array_sort(F.collect_list(F.struct("metric", "value")))
    metrics.agg(F.to_json(F.map_from_entries(pairs), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of such an object."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    return rows.select(F.explode("m").alias("metric", "value"))


def format_metrics(metrics: DataFrame) -> DataFrame:
    """(metric, value) as text with four digits, by name."""
    return metrics.orderBy("metric").select("metric", F.format_string("%.4f", "value").alias("value"))


def write_records(records: DataFrame, path: str) -> None:
    """Benchmark records as JSON lines."""
    records.write.mode("overwrite").json(path)


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    """(id, embedding): standard normal vectors, made on the executors."""
    return spark.range(n).select("id", F.array(*[F.randn(seed * 1009 + i).cast("float") for i in range(dim)]).alias("embedding"))


def random_sequences(spark: SparkSession, n: int, length: int, seed: int = 1) -> DataFrame:
    """(id, seq): uniform residues over the first 24 letters of the alphabet; the id and place decide them."""
    from strandsift.functions.sequence import ALPHABET

    letter = lambda i: F.substring(F.lit(ALPHABET), F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(24)).cast("int") + 1, F.lit(1))
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "").alias("seq"))


def random_indices(spark: SparkSession, queries: int, k: int, below: int = 100_000, seed: int = 1) -> DataFrame:
    """(query_id, rank, db_id): uniform row numbers."""
    each = spark.range(queries).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return each.withColumn("db_id", F.pmod(F.xxhash64("query_id", "rank", F.lit(seed)), F.lit(below)))
