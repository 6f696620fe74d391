"""Timing of single operators over synthetic tables, as records (dict) of one run each.

A run writes the operator's rows to Spark's noop sink; inputs are made and cached first."""

from __future__ import annotations

import resource
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.functions import vector
from strandsift.operators import align, search
from strandsift.sources.files import random_indices, random_sequences, random_vectors


def timed(df: DataFrame, warmup: int = 1, iterations: int = 3) -> float:
    """Mean seconds of a run to the noop sink."""
    run = lambda: df.write.format("noop").mode("overwrite").save()
    for _ in range(warmup):
        run()
    begun = time.perf_counter()
    for _ in range(iterations):
        run()
    return (time.perf_counter() - begun) / iterations


def _ready(df: DataFrame) -> DataFrame:
    df = df.persist()
    df.count()
    return df


def _record(name: str, seconds: float, units: int, **sizes) -> dict:
    return {"benchmark": name, **sizes, "seconds": seconds, "latency_ms": 1000 * seconds, "throughput": units / seconds}


def benchmark_l2_normalize(spark: SparkSession, n: int = 10_000, dim: int = 128, **runs) -> dict:
    x = _ready(random_vectors(spark, n, dim))
    return _record("l2_normalize", timed(x.select(vector.l2_normalize(F.col("embedding")).alias("v")), **runs), n, n=n, dim=dim, gb=n * dim * 4 / 1e9)


def benchmark_cosine(spark: SparkSession, queries: int = 64, database: int = 10_000, dim: int = 128, **runs) -> dict:
    q, d = _ready(random_vectors(spark, queries, dim, 2)), _ready(random_vectors(spark, database, dim))
    return _record("cosine", timed(search.cosine_scores(q, d), **runs), queries, queries=queries, database=database, dim=dim)


def benchmark_topk(spark: SparkSession, queries: int = 64, database: int = 10_000, k: int = 10, dim: int = 128, strategy: str = "blocks", **runs) -> dict:
    q, d = _ready(random_vectors(spark, queries, dim, 2)), _ready(random_vectors(spark, database, dim))
    return _record("topk", timed(search.search(q, d, k, strategy), **runs), queries, queries=queries, database=database, k=k, dim=dim, strategy=strategy)


def benchmark_gather(spark: SparkSession, queries: int = 64, k: int = 10, database: int = 100_000, dim: int = 128, **runs) -> dict:
    hits, d = _ready(random_indices(spark, queries, k, database)), _ready(random_vectors(spark, database, dim))
    return _record("gather", timed(search.gather(hits, d), **runs), queries * k, queries=queries, k=k, database=database, dim=dim)


def benchmark_smith_waterman(spark: SparkSession, queries: int = 4, database: int = 64, length: int = 256, gap_open: int = 11, gap_extend: int = 1, **runs) -> dict:
    q, d = _ready(random_sequences(spark, queries, length, 2)), _ready(random_sequences(spark, database, length).repartition(spark.sparkContext.defaultParallelism))
    return _record("smith_waterman", timed(align.align_all(q, d, gap_open=gap_open, gap_extend=gap_extend), **runs), queries * database, queries=queries, database=database, length=length)


def baseline_numpy_cosine(queries: int = 64, database: int = 10_000, dim: int = 128, iterations: int = 3) -> dict:
    """One process, one matrix product."""
    draw = np.random.default_rng(1)
    q, d = draw.normal(size=(queries, dim)), draw.normal(size=(database, dim))
    begun = time.perf_counter()
    for _ in range(iterations):
        (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T
    return _record("numpy_cosine", (time.perf_counter() - begun) / iterations, queries, queries=queries, database=database, dim=dim)


def baseline_numpy_topk(queries: int = 64, database: int = 10_000, k: int = 10, iterations: int = 3) -> dict:
    s = np.random.default_rng(1).normal(size=(queries, database))
    begun = time.perf_counter()
    for _ in range(iterations):
        np.take_along_axis(s, np.argsort(-s, axis=1, kind="stable")[:, :k], 1)
    return _record("numpy_topk", (time.perf_counter() - begun) / iterations, queries, queries=queries, database=database, k=k)


def run_grid(spark: SparkSession, database_sizes=(10_000,), batch_sizes=(1, 8, 64), dim: int = 128, k: int = 10) -> list[dict]:
    """Every cell of the grid; a cell that fails is a record with the error."""
    out = []
    for n in database_sizes:
        cells = [lambda n=n: benchmark_l2_normalize(spark, n, dim)]
        for b in batch_sizes:
            cells += [lambda b=b, n=n: benchmark_cosine(spark, b, n, dim), lambda b=b, n=n: benchmark_topk(spark, b, n, k, dim), lambda b=b, n=n: benchmark_gather(spark, b, k, n, dim), lambda b=b, n=n: baseline_numpy_cosine(b, n, dim), lambda b=b, n=n: baseline_numpy_topk(b, n, k)]
        cells.append(lambda n=n: benchmark_smith_waterman(spark))
        for cell in cells:
            try:
                out.append(cell())
            except Exception as error:  # noqa: BLE001  the grid goes on
                out.append({"error": f"{type(error).__name__}: {error}"[:300], "database": n})
            spark.catalog.clearCache()
    return out


def profile_memory(spark: SparkSession, queries: int = 64, database: int = 100_000, dim: int = 128) -> dict:
    """One search; the peak memory of the driver's Python process in GB, and Spark's storage use."""
    result = benchmark_topk(spark, queries, database, 10, dim, warmup=0, iterations=1)
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    free = [status.apply(e)._2() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status.keys())]
    spark.catalog.clearCache()
    return {**result, "driver_peak_gb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e6, "executor_free_gb": sum(free) / 1e9}
