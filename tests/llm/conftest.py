import random

import pytest

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, digest string,"
    " found string, label string, rid string"
)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 8))) for _ in range(words))


def make_docs(spark, rows):
    """Documents of (doc_id, text), with further columns whose names clash with the operators'."""
    return spark.createDataFrame(
        [(i, t, "en", "src", None, "x", "x", None, "x", "x", "x") for i, t in rows], DOC_SCHEMA
    ).repartition(3)


@pytest.fixture(scope="session")
def tricky_rows():
    """Null ids and texts, empty and very long texts, repeated rows, and ids used twice."""
    return [
        (1, ""), (2, None), (None, "alpha beta"), (None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"),
        (4, prose(1, 40_000)), (5, "one"), (6, "?!"), (7, "?!"), (8, "   "), (9, prose(2, 60)), (9, prose(3, 60)),
        (None, None), (10, "x" * 100_000), (11, "\n\n\n"),
    ]


@pytest.fixture(scope="session")
def tricky(spark, tricky_rows):
    return make_docs(spark, tricky_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])


