import random

import numpy as np
import pytest

from strandsift.operators import search
from strandsift.streaming.search import stream_top_k

SCHEMA = "id long, embedding array<float>"


def run(stream, state, held):
    """Applies the updates of all that is there; returns how many micro-batches there were."""
    seen = []

    def keep(batch, number):
        seen.append(number)
        for r in batch.collect():
            held[r.query_id, r["rank"]] = (r.db_id, round(r.score, 8))

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return len(seen)


@pytest.mark.parametrize("exclude_self", [False, True])
def test_any_order_of_batches_and_a_restart_end_in_the_whole_result(spark, tmp_path, exclude_self):
    draw = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(120, 6)).astype(np.float32))]
    rows += [(200 + i, rows[3][1]) for i in range(6)] + [(300, None), (301, [1.0]), (302, [float("nan")] * 6), (3, rows[3][1])]
    everything = spark.createDataFrame(rows, SCHEMA)
    queries = everything.where("id % 20 in (0, 3) or id in (300, 301)")
    want = {(r.query_id, r["rank"]): (r.db_id, round(r.score, 8)) for r in search.search(queries, everything, 5, "blocks", exclude_self=exclude_self).collect()}
    random.Random(int(exclude_self)).shuffle(rows)
    folder, held = str(tmp_path / "in"), {}
    for i in range(4):
        spark.createDataFrame(rows[i * 33 : (i + 1) * 33], SCHEMA).coalesce(1).write.parquet(f"{folder}/{i}")
        if i in (1, 3):  # a restart between the two runs
            stream = stream_top_k(queries, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/*"), 5, exclude_self)
            assert run(stream, str(tmp_path / "state"), held) == 2
    assert held == want


def test_queries_have_a_bound(spark, tmp_path):
    queries = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], SCHEMA)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="components"):
        stream_top_k(queries, stream, block_values=10)
    with pytest.raises(ValueError, match="no query"):
        stream_top_k(queries.limit(0), stream)
