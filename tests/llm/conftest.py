"""Awkward inputs that every operator has to take."""

from __future__ import annotations

import pytest

LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, equal ids, repeated rows, extra columns whose names clash."""
    rows = [
        (1, "Released under the MIT License.\nthe same line stands here twice over\nend", "x", None, 1),
        (2, "", None, "s", 2),
        (3, None, "x", "s", None),
        (None, "a text without an id but with words", "x", "s", 4),
        (5, LONG, "x", "s", 5),
        (6, "the same line stands here twice over", "x", "s", 6),
        (6, "the same line stands here twice over", "x", "s", 6),
        (6, "another text of the same id", "x", "s", 6),
        (7, " \t\n ", "x", "s", 7),
        (8, "é ☃ 日本語 \U0001f600 İ ﬁ", "x", "s", 8),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # names that operators use themselves, one that differs from another in case only, and one that stands twice
    return df.selectExpr("*", "1 as h", "2 as score", "'q' as Text", "3 as part", "4 as row", "5 as c0", "6 as `c0`")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
