import random

import pytest

#: documents with columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, removed string, label string, rep string, size string, h string, n_tokens string, score string, a string, b string, `key` string, target string"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), *["x"] * 11, None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented prose: prose(seed, words) is always the same."""

    def make(seed, words, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))

    return make


#: Texts that every operator has to take.
ODD = [None, "", " \t\n ", "a", "a b c d", "é ñ 日本語  x", "x" * 70_000, "w " * 30_000, "\n\n\n", "A\x0bB\x0cC\rD"]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
