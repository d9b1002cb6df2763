from __future__ import annotations

import pytest

ODD = [
    (1, None, None, None, 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 3),
    (4, "one", "en", None, 3),
    (5, "The same text stands here twice, and nobody minds it at all today.", "en", "a", 66),
    (6, "The same text stands here twice, and nobody minds it at all today.", "en", "a", 66),
    (6, "The same text stands here twice, and nobody minds it at all today.", "en", "a", 66),
    (7, "wörter über Straßen und Bäume, dann noch ein paar mehr davon 😀", "de", "b", 60),
    (8, "long " * 30_000, "en", "b", 150_000),
    (9, "x" * 5_000, "en", "b", 5_000),
    (None, "a text without a number of its own", "en", "b", 34),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns that clash with work columns."""
    rows = [(*r, 1, "k", 2.0, True) for r in ODD]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, posterior double, held_out boolean"
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
