import random

import pytest

LETTERS = "abcdefghij"


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


def sentence(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(1 + rng.randrange(vocabulary) % 7)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and long texts, repeated rows, and columns whose names the operators use."""
    long_text = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "word", None, None, None), (None, "a b c d e f g", "en", "a", 1),
        (None, None, None, None, None), (4, long_text, "en", "b", 5), (5, " \n\t ", "de", "b", 3), (6, "x y z x y z x y z x y z", "xx", "b", 2),
        (7, "same text in two rows for a test of ties", "en", "a", 1), (7, "same text in two rows for a test of ties", "en", "a", 1),
        (8, "same text in two rows for a test of ties", "en", "a", 1), (9, "퟿ naïve \U0001f600 text", "fr", "c", 1),
    ]
    names = ["k", "words", "score", "mix_key", "block", "id", "n", "band", "component", "language", "epoch", "row", "tie"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame([(*r, *names) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
