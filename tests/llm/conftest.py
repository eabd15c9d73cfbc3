"""Documents with every awkward case, shared by the operators' tests."""

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) or longer rows."""

    def make(rows, extra=""):
        full = [(*r, *([None] * (5 - len(r)))) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, DOCUMENT + extra)

    return make


AWKWARD = [
    (None, "a text without an id, repeated"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "a text without an id, repeated"),
    (4, "a text without an id, repeated"),
    (5, "€ ß İ K 日本語 " * 3),
    (6, "word " * 50_000),
    (7, "...!!!"),
]
