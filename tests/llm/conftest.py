import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs."""

    def make(pairs):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


@pytest.fixture
def prose():
    """Makes texts of random words."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n, seed=0: " ".join(random.Random(f"{n}-{seed}").choices(vocabulary, k=n))


@pytest.fixture
def odd_pairs(prose):
    """Nulls, empty and very long texts, ties, repeated rows, odd blanks and characters."""
    long = prose(30_000, 1)
    return [
        (0, None),
        (1, ""),
        (2, " \t\n"),
        (3, "one"),
        (4, "two words"),
        (5, long),
        (6, long),
        (6, long),
        (7, prose(80, 2)),
        (8, prose(80, 2) + " end"),
        (None, prose(80, 2)),
        (None, None),
        (9, "a b   \U0001f600 \x0b x\x1cy é" * 20),
        (10, "same words here again\n" * 30),
        (11, "x" * 50_000),
    ]
