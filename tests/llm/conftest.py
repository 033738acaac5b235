import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t0 string, h long, size long, node string, ids string"


def row(i, text, source="s", lang="en"):
    """A document with further columns whose names the operators use themselves."""
    return (i, text, lang, source, None if text is None else len(text), "x", 7, 9, "n", "i")


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        return spark.createDataFrame([row(*r) for r in rows], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, ties and repeated rows, and a long text."""
    words = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) + str(k % 977) for k in range(30_000))
    return make([(1, None), (2, ""), (3, "  \n\t "), (4, "one two three four five"), (4, "one two three four five"), (5, "one two three four five", None, None), (None, "no id here at all"), (6, words), (7, "naïve café ÜBER 東京 😀 x y", "t", "xx")])


@pytest.fixture(scope="session")
def none(make):
    return make([(1, "x")]).where("false")
