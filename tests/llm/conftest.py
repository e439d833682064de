import pytest

from glyphmill.scratch import scratch_dir


@pytest.fixture
def documents(spark):
    """Rows as a documents table, as ``(doc_id, text, source)``."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def stored(spark):
    """A folder in which the named frames lie as the tables of a data set."""

    def make(**tables):
        at = scratch_dir(spark, "tables")
        for name, df in tables.items():
            df.write.parquet(f"{at}/{name}.parquet")
        return at

    return make


#: Nulls, empty and blank texts, ties, a repeated row, a special string, odd white space, more than one block of text.
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one  two three  x\x1c y", "b"), (5, "same text here", "b"), (6, "same text here", None),
    (6, "same text here", None), (7, "say <|endoftext|> and </s> \U0001f600 中文", ""), (8, "word " * 30_000, "a"), (9, "x" * 5000, "c"), (None, "no id", "c"),
    (10, "tail \n\n space ", "\U0001f600"), (11, "� it's we'll 12345 !!! ...", "b"),
]


@pytest.fixture
def odd(documents):
    return documents(ODD)
