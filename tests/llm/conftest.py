import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids_sha256 string, bpe_ids int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n", "en", "a", 3),
        (4, "one two three four five six", "en", "a", 27),
        (4, "one two three four five six", "en", "a", 27),
        (5, "ONE two  three four five\nsix", "en", None, 27),
        (6, "wörter über straße und größe " * 4000, "de", "b", 116000),
        (None, "token = abcdefgh12345678 über é😀", None, "b", 30),
        (7, "x" * 50000, "en", "b", 50000),
    ]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
