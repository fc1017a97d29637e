import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, row string, a string, key int"


def prose(rng, n, words=None):
    syllables = ["an", "re", "tion", "ou", "le", "er", "sta", "mi", "no", "qua"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def thue_morse(n=10):
    """Two words of 2^n letters that any polynomial hash modulo a power of two takes for the same."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="session")
def hard(spark):
    """Null, empty and blank texts, a very long one, one long word, repeated rows, copies, and clashing columns."""
    rng = random.Random(5)
    base = prose(rng, 80)
    long = prose(rng, 60_000) + " mail me at big.one@long.example.org or +1 (212) 555-0100"
    texts = [None, "", " \t\n\r ", "one", long, base, base, base + " tail", "x" * 70_000, "é" * 500, "MIT License\nMIT License\n日本語 текст", prose(rng, 300), "\x00 nul \x1c a▁b <|endoftext|>"]
    rows = [(i, t, None, "s", None, 0.5, False, "r", "a", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, "en", None, 3, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (11, 1, 0), (8, 0, 0), (9, 0, 1), (None, 1, 0), (999, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
