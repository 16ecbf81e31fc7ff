from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Builds a table of documents from texts, or from (id, text, source) rows."""

    def build(texts, parts=3):
        rows = [t if isinstance(t, tuple) else (i, t, f"s{i % 3}") for i, t in enumerate(texts)]
        return spark.createDataFrame(
            [(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA
        ).repartition(parts)

    return build


@pytest.fixture
def odd(documents):
    """NULLs, empty and blank texts, ties, repeated rows, a very long text, clashing names."""
    texts = [
        (1, None, "a"), (2, "", None), (3, " \n\t", "a"), (None, "one two three", "b"),
        (4, "one two three", None), (4, "one two three", None), (5, "word " * 30_000, "a"),
        (6, "Émile 漢字 😀 and one two three", "b"),
    ]
    df = documents(texts)
    names = ("sha", "class", "size", "target", "best", "TEXT", "__score", "term", "block")
    clash = df.selectExpr("*", *[f"'x' AS `{n}`" for n in names if n != "TEXT"])
    return clash.toDF(*clash.columns[:-1], "TEXT")
