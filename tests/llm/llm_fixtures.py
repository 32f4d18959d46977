"""Fixtures and helpers of these tests. They are imported, as a second conftest would hide the first."""

from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table of documents, with columns that clash."""

    def build(rows, partitions: int = 3):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        extra = "key digest kept order size bucket row node slot shard length label read id whole".split()
        return df.selectExpr("*", *[f"'x' AS {name}" for name in extra]).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Null, empty and very long texts, null ids, ties and repeated rows."""
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, None),
        (4, "one", "en", None),
        (5, "one", None, "b"),
        (5, "one", None, "b"),
        (6, "long " * 60_000 + "end", "en", "b"),
        (7, "x" * 300_000, "de", "c"),
        (8, "ünï ©ode 漢字   text <|endoftext|> 'll", "de", "c"),
        (None, "one", None, None),
        (None, None, None, None),
        (9, "one\ttwo  three", "en", "a"),
        (10, "one two three", "en", "a"),
    ]


@pytest.fixture()
def rng():
    return random.Random(7)


def words(rng, n: int, letters: str = "abcdefghij") -> list[str]:
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]
