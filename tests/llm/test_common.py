import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandsift.llm import common


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_encoded(kind):
    values = ["a", None, "", "é\U0001f600", "z" * 1000]
    column = pa.array(values, kind)
    assert list(common.encoded(column)) == [(v or "").encode() for v in values]
    assert list(common.encoded(column.slice(2, 2))) == [b"", "é\U0001f600".encode()]
    assert list(common.encoded(pa.chunked_array([column, column]))) == [(v or "").encode() for v in values * 2]
    assert list(common.encoded(pa.array([None, None], kind))) == [b"", b""] and list(common.encoded(pa.array([], kind))) == []
    assert common.strings(column) == [v or "" for v in values]


def test_the_sessions_folder_is_used(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert common.ensure_shared_dir(spark) == folder
    assert common.stored(spark.range(10)).inputFiles()[0].startswith(f"file://{folder}/table-")
    assert common.materialize(spark.range(5)).count() == 5
    assert "broadcast" in common.small(spark.range(5))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.small(spark.range(5), rows=4)._jdf.queryExecution().logical().toString().lower()


def test_first_by_hash_is_the_plain_order(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "key").union(spark.createDataFrame([(7,)] * 3000, "key long"))
    plain = keys.distinct().orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(50)
    got = common.first_by_hash(keys, "key", 50)
    assert [r.key for r in got.collect()] == [r.key for r in plain.collect()]
    assert common.first_by_hash(keys.limit(0), "key", 5).count() == 0 and common.first_by_hash(spark.range(3).withColumnRenamed("id", "key"), "key", 5).count() == 3


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, _A int, b int")
    assert common.free_name(df, "c") == "c" and common.free_name(df, "a") == "__a" and common.free_name(df, "B") == "_B"


def test_short_batches_leave_a_setting_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for own, want in (("10000", "1000"), ("77", "77")):
            spark.conf.set(key, own)
            common.short_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_marked_rows(spark):
    """Bits over places far apart, by key and without, are the rows asked for; none, if none are."""
    rows = [(f, i) for f in ("a", "b", "c") for i in (0, 1, 7, 8, 32_767, 32_768, 40_000, (1 << 33) + 5, (3 << 33) + 9)]
    df = spark.createDataFrame(rows, "file string, index long")
    some = [r for n, r in enumerate(rows) if n % 3 == 0 and r[0] != "c"]
    chosen = spark.createDataFrame(some, df.schema)
    assert sorted(map(tuple, common.marked(df, chosen, "index", ("file",)).where("marked").drop("marked").collect())) == sorted(some)
    assert {r["index"] for r in common.marked(df, chosen, "index").where("marked").collect()} == {i for _, i in some}
    assert common.marked(df, chosen.limit(0), "index").where("marked").count() == 0
