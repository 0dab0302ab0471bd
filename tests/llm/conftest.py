import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, cluster string, `_n` int, removed string, kept string"

#: Nulls in every column, blank and very long texts, ties, repeated rows, columns named like inner ones.
ODD = [
    (None, None),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r"),
    (4, "word"),
    (5, "word"),
    (5, "word"),
    (None, "word " * 40),
    (6, "x" * 300_000),
    (7, ("long text with many words " * 4000) + "end"),
    (8, ("long text with many words " * 4000) + "end"),
    (9, "naïve café — \U0001f600 " * 30),
    (10, "a b c d e f g h i j k l m n o p"),
    (11, "a b c d e f g h i j k l m n o p"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None, None if k % 3 else "s", None, 1, "c", 2, "r", "k") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session", name="corpus")
def _corpus():
    return corpus


@pytest.fixture(scope="session")
def words():
    """A seeded source of texts that share passages."""
    import random

    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [" ".join(random.choices(vocabulary, k=random.randint(10, 40))) for _ in range(8)]

    def text():
        parts = []
        for _ in range(random.randint(0, 6)):
            parts.append(random.choice(passages) if random.random() < 0.5 else " ".join(random.choices(vocabulary, k=random.randint(1, 25))))
        return random.choice([" ", "\n", "  "]).join(parts)

    return text
