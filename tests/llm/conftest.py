"""Awkward documents that every operator has to survive."""

from __future__ import annotations

import pytest

LONG = "word " * 60_000

EDGE = [
    (1, "plain text of a few words here and there", "s"),
    (1, "plain text of a few words here and there", "s"),
    (2, None, None),
    (3, "", "s"),
    (None, "a text without an id but with words", "s"),
    (4, " \t\n \r\n ", "s"),
    (5, LONG, "s"),
    (6, "ünïcode ß İ \U0001f600 中文 \x00 end", "s"),
    (7, "plain text of a few words here and there", "s"),
    (1, "another text under an id that is taken", "t"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names clash
    with those that operators make."""
    rows = [(*r, 1, "x", 2) for r in EDGE]
    return spark.createDataFrame(rows, SCHEMA + ", n_words int, spans string, ids int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
