"""Search over streams: query vectors against a static database, and a growing database against static queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandsift.operators.search import _BLOCK_VALUES, _block_top_k, _blocks, _matrices, search


def stream_search(queries: DataFrame, database: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 10, checkpoint: str | None = None, **options):
    """Starts a streaming query that answers each micro-batch of ``queries`` (id, embedding) and hands the hits, with
    the batch's number, to ``sink``, which makes the write idempotent by that number."""

    def answer(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            sink(search(kept, database, k, **options), number)
        finally:
            kept.unpersist()

    writer = queries.writeStream.foreachBatch(answer).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stream_top_k(queries: DataFrame, database: DataFrame, k: int = 10, exclude_self: bool = False, block_values: int = _BLOCK_VALUES) -> DataFrame:
    """(query_id, rank, db_id, score) of static ``queries`` against all that has come so far of the stream ``database`` (both id,
    embedding), for output mode 'update': whenever a query's ``k`` nearest change, all of them are sent again, so that a sink
    that keeps the last row of each (query_id, rank) holds what ``search`` gives over the same rows, in whatever order they
    came. The state of a query is its k hits. Rows without an id are left out; queries beyond ``block_values`` components are
    an error: take several streams."""
    queries, database = queries.select("id", "embedding").where("id is not null and embedding is not null"), database.select("id", "embedding").where("id is not null")
    if _blocks(queries, block_values) > 1:
        raise ValueError(f"the queries have more than {block_values} components")
    kinds = (queries.schema["id"].dataType.simpleString(), database.schema["id"].dataType.simpleString())
    kind = to_arrow_type(queries.schema["id"].dataType)
    parts = [_block_top_k(database, ids, matrix, k, exclude_self, kinds, kind) for ids, matrix in _matrices(queries).values()]
    if not parts:
        raise ValueError("there is no query")

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = list(zip(*state.get, strict=True)) if state.exists else []
        held = before
        for batch in batches:  # as many hits as Arrow batches gave, in pieces
            held = sorted([*held, *zip(batch["db_id"].tolist(), batch["score"].tolist(), strict=True)], key=lambda x: (-x[1], x[0]))[:k]
        if held != before:
            ids, scores = [list(x) for x in zip(*held, strict=True)]
            state.update((ids, scores))
            yield pd.DataFrame({"query_id": [key[0]] * len(ids), "rank": range(1, len(ids) + 1), "db_id": ids, "score": scores})

    schema = f"query_id {kinds[0]}, rank int, db_id {kinds[1]}, score double"
    return reduce(DataFrame.unionByName, parts).groupBy("query_id").applyInPandasWithState(merge, schema, f"ids array<{kinds[1]}>, scores array<double>", "update", GroupStateTimeout.NoTimeout)
