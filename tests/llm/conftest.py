import pytest

#: Rows that every operator over documents must take: nulls, empties, repeats, ties, and names that clash.
ODD = [
    (1, "one two three four five six seven", "en", "a", 7, "x"),
    (1, "one two three four five six seven", "en", "a", 7, "x"),
    (2, "", "en", None, 0, None),
    (3, None, None, "b", None, "y"),
    (None, "one two three four five six seven", "en", "a", 7, "z"),
    (4, "   \t\n ", "de", "b", 4, "y"),
    (5, "word " * 30000, "en", "a", 150000, "long"),
    (6, "naïve café <|endoftext|> ñandú 中文 🙂", "es", "a", 30, "u"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
