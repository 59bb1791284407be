import pytest

LONG = "slovo " * 20_000

#: doc_id, text, lang, source: nulls in any column, empty and long texts, repeated rows, ties.
ROWS = [
    (1, "Alpha beta gamma delta", "en", "a"),
    (2, "Alpha  beta\tgamma delta ", "en", "a"),
    (2, "Alpha  beta\tgamma delta ", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t", "en", "b"),
    (6, LONG, "sk", "b"),
    (None, "text without an id", "en", "a"),
    (7, "one two\none two\n\nthree", "en", "c"),
]


@pytest.fixture(scope="session")
def docs(spark):
    # Columns with names that operators use themselves.
    rows = [(*r, "x", 1) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, entry string, kept int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
