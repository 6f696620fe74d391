"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one works on all that it kept. All but the
last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.llm import decontaminate, packing, pii, similar, toxicity
from strandsift.llm.common import crc_remainder, free_name, short_batches, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under one half; learnt from the labels outside the held-out fold.

    A null or empty text has the score of a text without words; rows that repeat are scored each, and a long text whole;
    with an empty table, or labels of one kind only, the score is the labels' share of toxic rows; columns may have any
    name."""
    short_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(crc_remainder("doc_id", 5) != 0)
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, toxicity.fit(docs, labels), output=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; null ids come last.

    Null and empty texts are one group, of which one row stays, besides rows with neither id nor text, which all stay;
    rows that repeat are near-duplicates; ties go to the first row read; an empty table stays empty; columns may have any
    name."""
    short_batches(spark)
    return similar.drop_near_duplicates(docs, words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of a benchmark item. Null and empty texts stay, as does everything if the
    benchmark is empty; rows that repeat are judged each; columns may have any name."""
    short_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets; n_chars follows the new text. Null texts stay
    null, with a null n_chars, and empty ones empty; rows that repeat are masked each; an empty table stays empty; columns
    may have any name."""
    short_batches(spark)
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, each source at its share of all tokens. Null and empty
    texts have their end id; null sources are a queue of their own; rows that repeat are packed each; an empty table gives
    no piece; columns may have any name."""
    import public_tokenizers  # needed by nothing else

    short_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL can express neither the classifiers nor the tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
