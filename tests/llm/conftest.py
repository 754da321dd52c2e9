import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls everywhere, empty, long and repeated texts, repeated rows, a clashing extra column."""
    long = "Many words of plain text stand here and none of them says much at all, number {}. "
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \n ", None, "b"), (None, "A text without an id that is short.", "en", None),
        (4, "".join(long.format(n) for n in range(300)), "en", "a"), (5, "".join(long.format(n) for n in range(300)), "en", "b"),
        (6, "word " * 20000, "en", "a"), (7, "x", "fr", "a"), (7, "x", "fr", "a"), (8, "Même texte, une fois encore — naïve 😀", "fr", "c"),
        (9, "12345 67890", "en", "a"),
    ]
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, hash long, key string"
    )
