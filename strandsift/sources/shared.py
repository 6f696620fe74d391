"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir; where that is unset, in a temporary folder in local mode, and an
    error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strandsift-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def one_by_one(parts: Iterable[DataFrame], several: bool) -> DataFrame:
    """The union of ``parts``. Where there are several, each is computed and written before the next is even planned, so
    that only one part's broadcast is alive at a time."""
    if not several:
        return next(iter(parts))
    out = None
    for part in parts:
        path = scratch(part.sparkSession, "part")
        part.write.parquet(path)
        one = part.sparkSession.read.schema(part.schema).parquet(path)
        out = one if out is None else out.unionByName(one)
    return out
