import pytest

from tracklens.llm.common import table


@pytest.fixture(scope="session")
def documents(spark, small):
    return table(spark, small, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns that clash with internal names."""
    long = "Lorem ipsum 12 dolor " * 5000
    rows = [
        (1, "a b c d e", "en", "s1", 5, 7), (2, "a b c d e", "en", "s1", 5, None), (2, "a b c d e", "en", "s1", 5, None), (None, "a b c d e", None, None, None, 1),
        (3, None, "en", "s2", None, 1), (4, "", "en", "s2", 0, 1), (5, " \n\t ", "fr", None, 3, 1), (6, long, "de", "s3", len(long), 1),
        (7, long, "de", "s3", len(long), 1), (8, "A B C D E", "en", "s1", 5, 1), (None, None, None, None, None, None), (9, "é ü 漢字 😀 x@y.zz", "fr", "s4", 9, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_ long")
