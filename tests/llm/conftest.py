from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LINE = "hello there my friend how are you doing on this fine and sunny day of the year "


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, blank lines, a column of another table's name."""
    rows = [
        (None, None, None, None, None, "a"),
        (1, "", None, None, 0, "b"),
        (2, LINE * 3, "en", "s", 3, None),
        (2, LINE * 3, "en", "s", 3, None),
        (None, LINE * 3, "en", "s", 3, None),
        (4, "x" * 60_000, "en", None, 1, "q"),
        (5, "\n\n \n", "fr", "s", 1, ""),
        (2**53 + 1, "a b c d e f g", "fr", "s", None, ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
