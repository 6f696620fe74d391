"""Exact ranks, splits, limits, labels and batches without a sort of all rows in one task."""

from __future__ import annotations

from math import gcd
from random import Random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, bucket: Column, order: list, name: str = "position") -> DataFrame:
    """``df`` with a gapless long column ``name`` from 0, in the order of ``bucket`` and then of ``order``.

    ``bucket`` must be a coarse non-decreasing function of the order: rows are numbered within their bucket and offset
    by the counts of earlier buckets, so a task only ever holds one bucket."""
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_bucket", (F.sum("_rows").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1)
    return own.join(before, rows["_bucket"].eqNullSafe(before["_bucket"])).select(*[own[c] for c in df.columns], (F.col("_own") + F.col("_before")).cast("long").alias(name))


def shuffled(df: DataFrame, key: str = "id", seed: int = 42, name: str = "position") -> DataFrame:
    """``df`` with its position in a seeded shuffle: the order of md5('seed:key'), then the key."""
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    return ranked(hashed, F.substring("_hash", 1, 4), ["_hash", key], name).drop("_hash")


def train_val_split(df: DataFrame, val_ratio: float = 0.1, seed: int = 42, key: str = "id") -> DataFrame:
    """``df`` with a column split: the first floor(n * val_ratio) of the seeded shuffle are 'val', the rest 'train'."""
    n = F.lit(df.count())
    return shuffled(df, key, seed, "_position").withColumn("split", F.when(F.col("_position") < F.floor(n * F.lit(float(val_ratio))), "val").otherwise("train")).drop("_position")


def three_way_split(df: DataFrame, train_ratio: float = 0.8, val_ratio: float = 0.1, seed: int = 42, key: str = "id") -> DataFrame:
    """``df`` with a column split: floor(n * train_ratio) 'train', floor(n * val_ratio) 'val', the rest 'test'."""
    n = df.count()
    train = int(n * train_ratio)
    val = train + int(n * val_ratio)
    return shuffled(df, key, seed, "_position").withColumn("split", F.when(F.col("_position") < train, "train").when(F.col("_position") < val, "val").otherwise("test")).drop("_position")


def first_rows(df: DataFrame, n: int | None, order: str = "seq_no") -> DataFrame:
    """The first ``n`` rows in ``order``; None or 0 means all."""
    return df.orderBy(order).limit(n) if n else df


def pair_product(queries: DataFrame, database: DataFrame, max_pairs: int | None = None, seed: int | None = None) -> DataFrame:
    """(i, j, query_id, db_id, query_seq, db_seq): every pair in row-major order of (i, j), the first ``max_pairs`` of
    them (None or 0: all), in a seeded shuffle if ``seed`` is given. Inputs have columns seq_no, id, seq; rows with an
    empty or null sequence make no pair. With a cap, only as many queries take part as the cap can reach."""
    q = queries.where("seq <> ''").select(F.col("seq_no").alias("i"), F.col("id").alias("query_id"), F.col("seq").alias("query_seq"))
    d = database.where("seq <> ''").select(F.col("seq_no").alias("j"), F.col("id").alias("db_id"), F.col("seq").alias("db_seq"))
    if max_pairs:
        rows = max(1, d.limit(max_pairs).count())
        q = q.orderBy("i").limit(-(-max_pairs // rows))
        d = d.orderBy("j").limit(max_pairs)
    out = d.crossJoin(F.broadcast(q) if max_pairs else q).select("i", "j", "query_id", "db_id", "query_seq", "db_seq")
    if max_pairs:
        out = out.orderBy("i", "j").limit(max_pairs)
    return out if seed is None else out.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "i", "j").cast("binary")))


def dense_label(df: DataFrame, family: str = "family", name: str = "label") -> DataFrame:
    """``df`` with labels from 0 by the order of the family names; only the distinct families are sorted."""
    names = df.select(F.col(family).alias("_family")).distinct().withColumn(name, F.dense_rank().over(Window.orderBy("_family")) - 1)
    return df.join(names, F.col(family).eqNullSafe(F.col("_family"))).drop("_family")


def _quantile_bucket(df: DataFrame, order: str, rows: int = 50_000, most: int = 10_000) -> Column:
    """The bucket of ``order`` between its quantiles, about ``rows`` rows each, at most ``most`` buckets. Rows of one value are
    in one bucket."""
    n = max(2, min(most, -(-df.count() // rows)))
    found = df.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 10 * n)).first()[0]
    borders = F.array(*[F.lit(x) for x in sorted(set(found))]) if found else None
    return F.lit(0) if borders is None else F.when(F.col(order).isNull(), F.lit(-1)).otherwise(_below(borders, F.col(order)))


def _below(borders: Column, value: Column) -> Column:
    """How many of the sorted ``borders`` are below ``value``, by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(borders) + 1)).cast("int") + 1)
    zero = F.struct(F.lit(0).alias("low"), F.size(borders).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        right = (at["low"] < at["high"]) & (F.get(borders, middle) < value)
        return F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"), F.when(right | (at["low"] >= at["high"]), at["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, zero, halve, lambda at: at["low"])


def batches(df: DataFrame, batch_size: int = 32, order: str = "seq_no", width: int | None = None, shuffle: bool = False, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(batch, rows): arrays of ``batch_size`` rows as structs in the order of the whole-number column ``order``; the
    last may be shorter. ``width``: the span of ``order`` that a task numbers at a time (default: spans between quantiles, so
    that they hold about equally many rows, however the values lie). ``shuffle``: in a seeded order instead, another one for each ``epoch``."""
    if shuffle:
        placed = shuffled(df, order, seed + epoch, "_position")
    else:
        if width is None:
            placed = ranked(df, _quantile_bucket(df, order), [order], "_position")
        else:
            placed = ranked(df, F.floor(F.col(order) / F.lit(width)), [order], "_position")
    row = F.struct(F.col("_position"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    grouped = placed.groupBy(F.floor(F.col("_position") / F.lit(batch_size)).cast("long").alias("batch")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select("batch", F.transform("rows", lambda r: r["row"]).alias("rows"))


def padded_width(length: Column, step: int = 64) -> Column:
    """What a row of ``length`` is padded to: a multiple of ``step``, or of a sixteenth of the next power of two where that is
    more, so that there are at most 16 widths between two powers of two and padding beyond a step is below an eighth."""
    n = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(1)).cast("long")
    bits = F.length(F.bin(n - 1))
    unit = F.greatest(F.lit(step).cast("long"), F.pow(F.lit(2.0), F.greatest(bits - 4, F.lit(0))).cast("long"))
    return (F.ceil(n / unit) * unit).cast("long")


def budget_batches(df: DataFrame, budget: int, length: str = "length", key: str = "id", step: int = 64, seed: int = 42, epoch: int = 0, mix: bool = True, start: int = 0) -> DataFrame:
    """``df`` with columns batch (gapless from 0), slot (gapless from 0 in it) and width: rows of one width share a batch, as
    many as ``budget`` // width, or one where the width alone exceeds the budget; the last of each width may have fewer.

    Rows come in a seeded order, another one for each ``epoch``. ``mix`` deals the batches of all widths over the epoch;
    without it they come by width. What is in a batch depends on rows and seed alone, so its number is a cursor: with
    ``start`` an epoch goes on from that batch. A null length counts as 0; keys should be unique."""
    if budget < 1 or step < 1:
        raise ValueError("budget and step must be positive")
    names = [*df.columns, "width"]
    wide = df.withColumn("width", padded_width(F.col(length), step)).withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(key).cast("string")).cast("binary")))
    per = F.greatest(F.floor(F.lit(budget) / F.col("width")), F.lit(1)).cast("long")
    # one row a width, at most 16 for each doubling of the length
    counts = wide.groupBy("width").agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.ceil(F.col("n") / per).cast("long"))
    sums = Window.orderBy("width").rowsBetween(Window.unboundedPreceding, 0)
    firsts = counts.select(F.col("width").alias("_width"), (F.sum("n").over(sums) - F.col("n")).alias("_rows"), (F.sum("b").over(sums) - F.col("b")).alias("_batches"))
    placed = ranked(wide, F.struct("width", F.substring("_hash", 1, 3)), ["_hash", key], "_position").join(F.broadcast(firsts), F.col("width") == F.col("_width"))
    own = F.col("_position") - F.col("_rows")
    batch = F.col("_batches") + F.floor(own / per).cast("long")
    if mix:
        total = int(counts.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0])
        stride, offset = _stride(total, seed + epoch)
        batch = (batch * F.lit(stride) + F.lit(offset)) % F.lit(max(total, 1))
    out = placed.select(*names, batch.cast("long").alias("batch"), (own % per).cast("long").alias("slot"))
    return out.where(F.col("batch") >= start) if start else out


def _stride(n: int, seed: int) -> tuple[int, int]:
    """(stride, offset): x -> (x * stride + offset) mod n deals 0..n-1 to other places, each once; below 2**63 for n below 3e9."""
    if n < 3:
        return 1, 0
    draw = Random(seed)
    while gcd(stride := draw.randrange(1, n), n) > 1:
        pass
    return stride, draw.randrange(n)


def padding_share(placed: DataFrame, length: str = "length") -> DataFrame:
    """One row: which share of all positions in the batches of ``placed`` is padding; null without a row."""
    return placed.agg((1 - F.sum(F.coalesce(F.col(length), F.lit(0))) / F.sum("width")).alias("padding"))


def difference(df: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``df`` whose key ``other`` lacks."""
    return df.join(other.select(key).distinct(), key, "left_anti")
