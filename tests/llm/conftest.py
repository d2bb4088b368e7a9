"""Messy documents: nulls, empty and long texts, ties, repeated rows and clashing names."""

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, recipe string, fp bigint, "
    "n bigint, `rank` int, h string, block string, component_id bigint, _text string, _doc bigint, _again int"
)


def docs_of(spark, rows):
    """Documents with columns beyond those of the table, whose names operators use inside."""
    more = ("x", "y", 7, 8, 9, "z", "b", -1, "t", 3, 4)
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *more) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def messy(spark):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en"), (2, "", None), (3, "  \n ", "de"), (4, "Hello  world", "en"), (5, "Hello world", "en"), (5, "Hello world", "en"),
        (6, long, "en"), (7, long + " end", "en"), (None, "Hello world", None), (None, "nur null", "de"), (8, "12345 !!", "en"),
        (9, "x" * 50_000, "fr"), (10, "日本語 🙂 テキスト", None),
    ]
    return docs_of(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return docs_of(spark, [])
