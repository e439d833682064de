import pytest

from __spark_entry__ import entry, oracle_sql, queries
from glyphmill.catalog import QUERIES
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    line, equal = compare(spark, con, name, SF, oracle_sql().get(name))
    assert equal, line


def test_entry(spark):
    assert {r["status"] for r in entry(spark).collect()} == {"ok", "failed", "skipped"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXT_STAGES = [
    "convert_indent", "extract_first_code", "token_count", "budget_split", "pack_units",
    "render_prompt", "destination_path", "route_by_extension", "ignore_locations", "splice_methods", "read_text_normalized",
]


@pytest.mark.parametrize("name", TEXT_STAGES)
def test_text_stages_neither_shuffle_nor_leave_the_jvm(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", ["migrate_single_file", "migrate_two_files", "request_union", "rag_requests", "knn_exact"])
def test_no_cross_joins(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["migrate_single_file", "segment_units"])
def test_segmentation_is_computed_once(spark, name):
    """One lexing of each text, and in its one fold the one search for directives."""
    text = plan(queries()[name](spark, SF))
    assert text.count("elif|else|endif") == 1 and text.count("regexp_extract_all(") == 2
