import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, clashing column names."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1, 0.5, "p", 7, 1),
        (2, "one two three four five six seven eight nine ten eleven twelve", None, None, None, None, None, None, None),
        (2, "one two three four five six seven eight nine ten eleven twelve", None, None, None, None, None, None, None),
        (3, None, "en", "a", 0, 1.0, "q", 1, 2),
        (4, "", "de", "b", 0, 1.0, "q", 1, 2),
        (5, " \t\n ", "de", "b", 0, 1.0, "q", 1, 2),
        (None, "a text without any id of its own, yet with words enough to count", "en", "a", 3, 1.0, "q", 1, 2),
        (None, None, None, None, None, None, None, None, None),
        (6, long, "fr", "c", len(long), 1.0, "q", 1, 2),
        (7, "é" * 5000, "fr", "c", 5000, 1.0, "q", 1, 2),
        (8, "\U0001f600 emoji \x00 nul", "en", "c", 5000, 1.0, "q", 1, 2),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, shard int, row long"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
