import random

import pytest

#: Nulls, empty texts, blanks only, ties, repeated rows and a missing doc_id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (6, "A b C d e f g h i j"), (None, "no id here"), (None, None), (7, "ß é 日本 🙂 word" * 3), (8, "same text twice here now ok"), (9, "same text twice here now ok")]
SCHEMA = "doc_id long, text string"


@pytest.fixture
def odd(spark):
    """With extra columns whose names the operators use inside."""
    rows = [(d, t, "x", 1.5, True, 3, [1]) for d, t in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", id string, score double, kept boolean, start int, bands array<int>")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def long_text():
    rng = random.Random(4)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60_000))


@pytest.fixture
def prose():
    def make(n, seed=0, vocabulary=3000):
        rng = random.Random(seed)
        words = ["".join(random.Random(i).choices("abcdefghijklmnop", k=2 + i % 8)) for i in range(vocabulary)]
        return " ".join(rng.choice(words) for _ in range(n))

    return make
