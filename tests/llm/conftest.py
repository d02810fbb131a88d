from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 997} x{i}" for i in range(30_000))
EDGES = [
    (1, "the quick brown fox jumps over the lazy dog\nline two is here\nline three is here\nthe end of it", "en", "b"),
    (2, "the quick brown fox jumps over the lazy dog\nline two is here\nline three is here\nthe end of it", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog\nline two is here\nline three is here\nthe end of it", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t\n\x0b ", "en", None),
    (6, LONG, "en", "b"),
    (7, LONG + " tail", "en", "b"),
    (None, "no id but text a@b.co token = \"abc123def456\"", "en", "c"),
    (None, None, "en", "c"),
    (8, "one", "en", "c"),
    (9, "ünï 日本語 \U0001f389 's 12 ...   spaces  ", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, SCHEMA)
    names = ["n_chars", "doc", "size", "pattern", "kept", "n_lines", "version", "h", "label", "component_id", "n_words", "ids", "id"]
    return df.withColumns({n: F.lit(n) for n in names})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
