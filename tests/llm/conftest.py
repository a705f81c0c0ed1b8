from __future__ import annotations

import pytest

#: Null and empty texts, a null source, a null id, a repeated row, ties, a long text, and names that operators use inside.
LONG = " ".join(f"word{i % 977}" for i in range(300_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "a", 1, "x", 9),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "a", 1, "x", 9),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "a", 1, "x", 9),
    (3, None, "b", 2, "x", 9),
    (4, "", "b", 2, None, 9),
    (5, " \t\n", None, 2, "y", 9),
    (None, "a text without an id", "b", 3, "y", None),
    (7, LONG, "c", 3, "y", 9),
    (8, "Ünïcödé wörds 😀 and more words here", "b", 3, "z", 9),
]
SCHEMA = "doc_id bigint, text string, source string, _group int, `row` string, shard int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
