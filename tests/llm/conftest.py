"""Small tables with the cases that every operator must take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, fp long, word string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    words = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew strange potions tonight"
    rows = [
        (1, words, "en", "a", 5, 1, 1, 1, "x"),
        (2, words, "en", "a", 5, None, 1, 1, None),
        (3, words + " again", None, None, None, 1, 1, 1, "x"),
        (4, None, "de", "b", 0, 1, 1, 1, "x"),
        (5, "", "de", "b", 0, 1, 1, 1, "x"),
        (6, " \n\t ", "fr", None, 3, 1, 1, 1, "x"),
        (7, "x" * 200_000, "fr", "b", 1, 1, 1, 1, "x"),
        (8, "der die das und nicht " * 4000, "de", "b", 1, 1, 1, 1, "x"),
        (9, "Éte à la plage, où l'été dure toujours et encore.", "fr", "c", 1, 1, 1, 1, "x"),
        (9, "Éte à la plage, où l'été dure toujours et encore.", "fr", "c", 1, 1, 1, 1, "x"),
        (None, "no id here", "en", "c", 1, 1, 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
