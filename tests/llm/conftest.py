import pytest


@pytest.fixture
def documents(spark):
    """Odd rows: nulls in every column, empty and blank texts, repeats, ties, a long text, and columns whose names operators use inside."""
    text = "the quick brown fox jumps over the lazy dog and runs away from the hunter " * 3
    rows = [
        (1, text, "en", "a"), (2, text, "en", "b"), (3, text.replace(" ", "  \n"), "en", "a"), (3, text, "en", None), (3, text, "en", None), (4, None, None, None), (5, "", "de", "a"),
        (6, " \t\n", None, "b"), (None, text, "en", "b"), (None, "nur ein kurzer satz", "de", "a"), (7, "nur ein kurzer satz", "de", "a"), (8, "word " * 30_000, "en", "c"), (9, "12345 67890", "en", "c"), (10, "é漢😀 ßü", None, "é"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), i, "x", 0.5) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, rid bigint, name string, size double")


@pytest.fixture
def empty(documents):
    return documents.limit(0)
