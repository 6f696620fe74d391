"""Command line: python -m strandsift.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandsift.operators import metrics, split
from strandsift.plans import timing
from strandsift.sources import fasta, files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strandsift")
    commands = parser.add_subparsers(dest="command", required=True)
    stats = commands.add_parser("stats", help="counts and lengths of a FASTA file")
    stats.add_argument("input")
    keep = commands.add_parser("filter", help="records between two lengths with valid characters")
    keep.add_argument("input")
    keep.add_argument("--output", "-o", required=True)
    keep.add_argument("--min-len", type=int, default=0)
    keep.add_argument("--max-len", type=int, default=10_000)
    parts = commands.add_parser("split", help="a seeded split into three")
    parts.add_argument("input")
    for name in ("train", "val", "test"):
        parts.add_argument(f"--{name}", required=True)
    parts.add_argument("--seed", type=int, default=42)
    show = commands.add_parser("batches", help="the first batches of coded sequences")
    show.add_argument("--fasta", required=True)
    show.add_argument("--max-len", type=int, default=1024)
    show.add_argument("--batch-size", type=int, default=4)
    judge = commands.add_parser("evaluate", help="metrics of retrieved against relevant lists (JSON)")
    judge.add_argument("--retrieved", required=True)
    judge.add_argument("--relevant", required=True)
    judge.add_argument("--output")
    bench = commands.add_parser("bench", help="the timing grid")
    bench.add_argument("--db-sizes", nargs="+", type=int, default=[10_000, 100_000])
    bench.add_argument("--batch-sizes", nargs="+", type=int, default=[1, 8, 32, 64])
    bench.add_argument("--dim", type=int, default=128)
    bench.add_argument("--k", type=int, default=10)
    bench.add_argument("--output")
    bench.add_argument("--memory-only", action="store_true")
    return parser


def evaluate(spark: SparkSession, retrieved: str, relevant: str):
    """(metric, value) for two JSON files of lists."""
    hits, queries = files.read_lists(spark, retrieved), files.read_list_ids(spark, retrieved)
    return metrics.retrieval_metrics(queries, hits, files.read_lists(spark, relevant).select("query_id", "db_id"))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("strandsift").getOrCreate()
    if a.command == "stats":
        for name, value in fasta.fasta_stats(fasta.read_fasta(spark, a.input)).first().asDict().items():
            if value is not None:
                print(f"{name}: {value}")
    elif a.command == "filter":
        fasta.write_fasta(fasta.filter_fasta(fasta.read_fasta(spark, a.input), a.min_len, a.max_len), a.output)
    elif a.command == "split":
        fasta.split_fasta(fasta.read_fasta(spark, a.input), a.train, a.val, a.test, seed=a.seed)
    elif a.command == "batches":
        split.batches(fasta.sequence_dataset(spark, a.fasta, a.max_len).select("seq_no", "id", "codes"), a.batch_size).select("batch", F.size("rows").alias("rows"), "rows.id").orderBy("batch").show(5, truncate=60)
    elif a.command == "evaluate":
        found = evaluate(spark, a.retrieved, a.relevant).persist()
        for row in files.format_metrics(found).collect():
            print(f"{row.metric}: {row.value}")
        if a.output:
            files.save_metrics(found, a.output)
    else:
        records = [timing.profile_memory(spark, dim=a.dim)] if a.memory_only else timing.run_grid(spark, a.db_sizes, a.batch_sizes, a.dim, a.k)
        for record in records:
            print(json.dumps(record))
        if a.output:
            files.write_records(spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in records])), a.output)


if __name__ == "__main__":
    main()
