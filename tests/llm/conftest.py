import pytest

from roundscope.llm import support

COLUMNS = "doc_id long, text string, lang string, source string, _n long, size string, shard string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source); the other columns have names that operators use inside."""
    support.importable(spark)

    def frame(rows):
        full = [(*r, None, None)[:4] if len(r) < 4 else tuple(r) for r in rows]
        return spark.createDataFrame([(*r, 7, "x", "y") for r in full], COLUMNS)

    return frame


#: Nulls, empty and blank texts, ties, repeated rows, unusual characters and a long text.
ODD = [
    (1, "One two three four five, six."), (2, "One  two three\tfour five, six."), (3, None), (4, ""), (5, " \n "), (6, "One two three four five, six."),
    (6, "One two three four five, six."), (7, "é. 日本 😀 a.b,c x..y ,z don't"), (8, "word " * 30_000 + "end"), (9, "q" * 40_000), (None, "no id at all"), (10, "42"),
]
