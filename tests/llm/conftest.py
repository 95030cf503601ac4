"""Small tables with the awkward rows that every operator has to bear."""

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(0, "alpha beta gamma delta epsilon zeta", "a"), (1, None, "a"), (2, "", None), (3, " \t\n ", "b"), (4, "one", "b"), (5, LONG, "b"), (6, "alpha beta gamma delta epsilon zeta", None),
            (6, "alpha beta gamma delta epsilon zeta", None), (None, "a line without an id that is long enough", "a"), (None, None, None), (7, "x" * 3000, "é"), (8, "naïve ſtraße   \x1c ½ ²", "é")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("k", "s", "n", "size", "score", "doc", "copies", "bands", "target", "ids", "length", "_k", "_first"):
        d = d.withColumn(c, F.lit("clash"))
    return d.withColumn("lang", F.lit("en")).withColumn("n_chars", F.char_length("text").cast("long"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
