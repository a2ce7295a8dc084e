import pytest

#: Texts that every operator must take: none, empty, ties, repeated rows, marks of all kinds, and a long one.
ODD = [None, "", " \t\n", "a", "the the the", "é ñ ß", "12 34", "x" * 5000, "word " * 3000]


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, repeated rows and extra columns with names that operators use."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), i, "x") for i, t in enumerate(ODD)]
    rows += [(None, "the the the", None, None, None, None, None), (3, "a", "en", "s", 1, 3, "x"), (3, "a", "en", "s", 1, 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, kept string")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
