from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Rows that every operator over documents must take: nulls in each column, empty and blank texts, repeated rows,
#: equal ids with different texts, no spaces, a long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", None, 4),
    (None, "a text without an id but with words", "en", "a", 35),
    (None, None, None, "b", None),
    (5, "twice the same row", "en", "b", 18),
    (5, "twice the same row", "en", "b", 18),
    (6, "one id", "en", "a", 6),
    (6, "two texts, password=hunter2hunter2", "en", "c", 34),
    (7, "x" * 20_000, "en", "c", 20_000),
    (8, "word " * 6000, "en", "c", 30_000),
    (9, "é ü ß 漢字   \U0001f600 " * 5, "fr", "a", 70),
]

CLASHING = ["size", "key", "node", "score", "_score", "spans", "found", "may", "_id", "_node", "bands", "range", "taken", "target", "items", "start", "_row"]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with more columns, named as operators name theirs."""
    return odd.withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
