from __future__ import annotations

import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    (2, "The quick brown fox  jumps over\nthe lazy dog again", "en", "a"),
    (3, None, None, None),
    (4, "", "en", ""),
    (5, " \t\n", "en", "b"),
    (6, "one two", "en", "b"),
    (7, "word " * 30_000, "en", "a"),
    (None, "a text without an id", "en", "a"),
    (8, "naïve café — 日本語 <|endoftext|> x\x00y", "fr", "b"),
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a"),
    (9, "lone words that nothing else holds at all here", "en", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, a repeated row, and extra columns with clashing names."""
    rows = [(*r, len(r[1] or ""), 7, 0.5, 3, b"x", 1) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, size int, ids binary, component_id int").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
