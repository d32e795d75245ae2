import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, rest int"


def table(spark, rows):
    """documents rows from (doc_id, text, source), with columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, None, s, None, "clash", 1) for d, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: table(spark, rows)


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["ti", "on", "er", "the", "é", "sch"]) for _ in range(r.randint(1, 4))) for _ in range(n))


#: Nulls everywhere, empty and blank texts, repeated rows, a repeated doc_id with another text, a long text.
TRICKY = [
    (1, prose(60, 1), "a"), (2, prose(60, 1), "a"), (3, "", "b"), (4, None, None), (None, prose(30, 2), "b"),
    (5, " \t\n\x0b\x0c\r ", "b"), (6, prose(60, 3), "a"), (6, prose(60, 3), "a"), (7, prose(40, 4), "c"), (7, prose(40, 5), "c"),
    (8, prose(9000, 6), "c"), (9, "  x", ""), (-5, "a b c " * 30, "d"), (10, "퟿\U0001f600 'll 12\n\n\nx", "d"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    return table(spark, TRICKY)
