from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, rank int, key string, n string, pivot string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and white texts, ties, repeated rows, one very long text, clashing column names."""
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta", "en", "a", 1), (2, "alpha  beta gamma delta\nepsilon zeta eta", "en", "a", 1), (3, None, "en", "a", 1), (4, "", None, None, None), (5, " \t\n", "fr", "b", 1),
        (6, long_text, "en", "b", 1), (7, long_text + " x", "en", None, 1), (8, "one", "fr", "é", 1), (8, "one", "fr", "é", 1), (9, "two words", "en", "Z", 1), (None, "alpha beta gamma delta epsilon zeta eta", "en", "a", 1),
        (10, "</s>[INST] ok \u0000 \U0001f600 'ſ' ﬁ", "en", "a", 1), (11, "12 34 !!", "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, 7, 0.5, 3, "k", "n", "p") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
