"""Documents with the cases that every operator has to define."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, law string, shard int, score double, size long"


def rows(texts: list[tuple]) -> list[tuple]:
    """(doc_id, text) or (doc_id, text, lang) with clashing extra columns."""
    return [(t[0], t[1], t[2] if len(t) > 2 else "en", "s", None, "x", None, 0.5, -1) for t in texts]


@pytest.fixture
def documents(spark):
    def make(texts: list[tuple]):
        return spark.createDataFrame(rows(texts), SCHEMA)

    return make


@pytest.fixture
def odd_texts() -> list[tuple]:
    long = " ".join(f"word{i % 997} and" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one"), (7, long), (8, long), (8, long), (None, "no id here"), (9, "Ünï çödé ñ, İstanbul Σίσυφος!"), (10, "a\x00b \x85   c"), (11, "<|endoftext|> is text")]
