import random

import pytest

WORDS = "the of and river stone light winter paper garden window people morning simple letter mountain silver yellow bridge".split()
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, key string, a long, removed string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "er", "est", "ly"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with NULLs in every column, empty, blank, long and repeated texts, and columns of clashing names."""
    rng = random.Random(4)
    long = "\n".join(sentence(rng, 40) for _ in range(2000))
    texts = [None, "", " \n\t ", "one", "!!! ... 123", sentence(rng, 60), long, sentence(rng, 60), "él niño 東京 😀 ok", "\x00\r\n\x0b"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 2}", len(t or ""), 1.0, "f", "k", 5, "r") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[5], None, None, None, None, None, None, None, None), (90, texts[5], "en", "s0", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def some_labels(spark):
    rows = [(i, i % 2, (i + 1) % 2, "x") for i in range(10)] + [(3, 1, None, "x"), (None, 1, 1, None), (5, None, None, None), (4, 7, 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
