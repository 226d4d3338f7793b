import pytest

from galeframe.llm.plans import WORD_BPE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000
#: Nulls in every column, empty and very long texts, ties and repeated rows.
ODD_ROWS = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, LONG, "en", "s", len(LONG)), (4, " \n\t\n ", "en", "s", 5), (5, "x" * 50_000, "en", "s", 50_000),
            (6, "one two", "en", "s", 7), (6, "one two", "en", "s", 7), (7, "One  TWO", "en", "s", 8), (None, "a text without an id, long enough", "en", "s", 30), (8, "ÄÖ é Ä\x00\n\n", None, "s", 9)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer_path():
    return WORD_BPE
