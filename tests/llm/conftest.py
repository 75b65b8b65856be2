"""Small tables with the awkward rows that every corpus operator must take."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source="s"):
    rows = [(i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, source="s": documents(spark, texts, source)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 4), (4, long, "en", "a", len(long)), (5, "one", "en", "b", 3),
        (5, "one", "en", "b", 3), (None, "no id here", "en", None, 10), (6, "é ü 🎈 end", None, "b", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
