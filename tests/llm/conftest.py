import random

import pytest

LETTERS = str.maketrans("0123456789", "aeioulnrst")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def prose():
    """Seeded invented prose: n words."""

    def make(n, seed, words=3000):
        r = random.Random(seed)
        return " ".join(f"w{int(r.random() ** 2 * words)}".translate(LETTERS) for _ in range(n))

    return make


#: Null, empty, blank, non-ASCII and long texts, and two equal ones.
ODD = [None, "", " \t\n ", "é漢😀 ﬁ Straße", "one", "one two", "same text here now", "same text here now", "x" * 5000, "word " * 3000]


@pytest.fixture
def odd(spark):
    """Odd texts under odd ids, with columns that clash with each operator's inputs and outputs."""
    rows = [(None if i == 4 else i, t, "score", "a", i, 1.5, "q") for i, t in enumerate(ODD)]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, `Text` string, n_lines string, component_id int, score double, `__text` string")
