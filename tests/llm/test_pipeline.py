import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandsift.llm import queries


def test_stages(spark, small, documents):
    """Each stage's decisions take effect, and the next one works on all that was kept."""
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        seen[name] = docs
        if name != "packing":
            assert docs.columns == documents.columns and [f.dataType for f in docs.schema] == [f.dataType for f in documents.schema]
    ids = {n: {r.doc_id for r in df.select("doc_id").distinct().collect()} for n, df in seen.items()}
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, small).where("predicted = 1").collect()}
    every = {r.doc_id for r in documents.collect()}
    assert ids["toxicity"] == every - toxic
    bad = {r.doc_id for r in queries.op4_decontamination(spark, small).where("contaminated").collect()}
    assert ids["decontamination"] == ids["near_duplicates"] - bad
    assert ids["personal_data"] == ids["decontamination"] == ids["packing"]
    masked = seen["personal_data"].collect()
    assert not any(re.search(r"[\w.]+@\w+\.\w+", r.text) for r in masked) and all(r.n_chars == len(r.text) for r in masked)
    assert corpus_pipeline.run(spark, small).agg(F.sum("length")).first()[0] == seen["packing"].agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, small, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd, small).count() > 0
    assert stage(spark, empty, small).count() == 0


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
