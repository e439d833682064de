"""Registered queries against their SQL, on a given table and on rows of every odd kind."""

import pytest

from glyphmill.llm.queries import QUERIES, SQL
from tools.check import compare, duck

from .conftest import ODD

CONVERSATIONS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"),
    (3, None, "assistant", "lost"), (3, 2, "user", ""), (None, 0, "user", "x"), (4, 0, "user", "hi"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (5, 0, "user", "é" * 3000),
    (5, 3, "assistant", "same"), (5, 4, "user", "more"), (-1, 0, "assistant", "neg"), (-2, 0, "assistant", "neg"), (9, 0, "assistant", "alone"),
]
BENCHMARK = [(1, "same text here"), (2, "it's"), (3, None), (4, ""), (5, "word word"), (7, "same text here")]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    line, equal = compare(spark, duck("/root/testdata/sf0.001"), name, "/root/testdata/sf0.001", SQL[name])
    assert equal, line


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("rows", [slice(None), slice(0)])
def test_query_equals_its_sql_on_odd_rows(spark, documents, stored, name, rows):
    tables = {
        "documents": documents(ODD[rows]),
        "benchmark": spark.createDataFrame(BENCHMARK[rows], "item_id long, text string"),
        "conversations": spark.createDataFrame(CONVERSATIONS[rows], "conv_id long, turn long, role string, text string"),
    }
    at = stored(**tables)
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{at.removeprefix('file:')}/{t}.parquet/*.parquet')")
    line, equal = compare(spark, con, name, at, SQL[name])
    assert equal, line


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
