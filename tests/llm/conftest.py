import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rule string"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and repeated rows, ties, a long text, and columns that clash with outputs."""
    a = "the quick brown fox jumps over the lazy dog while seven wizards box quietly in the rain today"
    b = "der schnelle braune Fuchs springt über den faulen Hund und niemand weiß genau warum er das tut"
    rows = [
        (0, a, "en", "x"), (1, a, "en", "x"), (1, a, "en", "x"), (2, a + " again", "en", None), (3, None, "en", "x"),
        (4, "", None, None), (5, "12 345 ... 6", "de", "y"), (6, b, "de", "y"), (7, b.upper(), "de", "y"),
        (None, b, None, "y"), (8, "one two", "en", "x"), (9, " ".join(f"word{i}" for i in range(30000)), "en", "x"),
        (10, "All rights reserved.", "en", "x"), (11, "x\nReleased under the MIT License.\ny", "en", "x"),
    ]
    return spark.createDataFrame([(*r, 1, 0.5, "r") for r in rows], DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
