"""Functions over vectors held as arrays, as native expressions; arithmetic is in doubles.

Null vectors give null. Vectors of unlike lengths give null scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v / (|v| + 1e-12): a zero vector stays zero. The norm is computed once per vector."""
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / (n + EPSILON)))
    return F.get(scaled, F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def _to_half(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in vectors:
        yield batch.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))


def quantise_fp16(v: Column) -> Column:
    """Rounded to half precision and back, for experiments with reduced precision."""
    return F.pandas_udf(_to_half, "array<float>")(v)


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors ``hidden`` (array of arrays) where ``mask`` is 1; by at least 1e-9 tokens."""
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    kept = F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x.cast("double") * m))
    zero = F.transform(F.get(hidden, F.lit(0)), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(kept, zero, lambda a, h: F.zip_with(a, h, lambda x, y: x + y)), lambda x: x / weight)


def cls_pool(hidden: Column) -> Column:
    """The first token's vector."""
    return F.get(hidden, F.lit(0))
