import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows with a clashing extra column."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, id string, h string")

    return make


#: Nulls, empties, blanks, one word, characters of several bytes, the text of a special token, repeats and ties.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d"), (6, "naïve 漢字 🙂 ok"), (7, "x <|endoftext|> y"), (8, "same text of six words here"), (9, "same text of six words here"), (10, "A" * 5000), (11, "12:30 don't  stop\r\n\nEND")]


@pytest.fixture(scope="session")
def odd():
    return ODD
