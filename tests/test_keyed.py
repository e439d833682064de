import pytest
from pyspark.sql import functions as F

from glyphmill.functions.embedding import TrigramEmbedder
from glyphmill.sources.keyed import KeyedTable, MergeConflict, embed_stored

SCHEMA = "id long, v string"


def rows(table):
    return sorted(((r["id"], r["v"]) for r in table.rows().collect()), key=str)


def test_rounds_equal_a_dictionary_and_leave_other_buckets_alone(spark, tmp_path):
    at = str(tmp_path / "t")
    table, model = KeyedTable(spark, at, SCHEMA, "id", buckets=8), {}
    assert rows(table) == []
    for new in [[(i, f"a{i}") for i in range(100)], [(i, f"b{i}") for i in range(50, 150)], [(3, "x"), (3, "y"), (None, "null")], []]:
        before = table.folders()
        assert table.merge(spark.createDataFrame(new, SCHEMA)) == len(new)
        model.update(dict(new))
        assert rows(table) == sorted(model.items(), key=str)
        assert len(new) >= 100 or sum(before[b] != f for b, f in table.folders().items()) <= len(new)
    # The number of buckets is the stored one; cleaning keeps what is in use.
    again = KeyedTable(spark, at, SCHEMA, "id", buckets=3)
    again.clean()
    assert again.buckets == 8 and rows(again) == sorted(model.items(), key=str)
    assert len(list((tmp_path / "t").glob("manifest-*"))) == 1


def test_a_merge_that_dies_or_comes_second(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "id", buckets=4)
    table.merge(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA))
    with pytest.raises(Exception, match="broken"):
        table.merge(spark.createDataFrame([(1, "c")], SCHEMA).withColumn("v", F.raise_error(F.lit("broken")).cast("string")))
    assert rows(table) == [(1, "a"), (2, "b")]
    number, content = table._manifest()
    table.merge(spark.createDataFrame([(1, "d")], SCHEMA))
    with pytest.raises(MergeConflict):
        table._commit(number + 1, content)
    assert rows(table) == [(1, "d"), (2, "b")]


def test_only_texts_that_are_new_are_embedded(spark, tmp_path):
    store = str(tmp_path / "vectors")
    df = spark.createDataFrame([(i, "same text") for i in range(30)] + [(30, "other text"), (31, None), (32, "")], "id long, text string")
    vectors, n = embed_stored(df, TrigramEmbedder(16), store, buckets=4)
    direct = {r["id"]: r["v"] for r in df.select("id", TrigramEmbedder(16).as_column(F.coalesce("text", F.lit(""))).alias("v")).collect()}
    assert n == 3 and {r["id"]: r["vec"] for r in vectors.collect()} == direct
    more = df.unionByName(spark.createDataFrame([(40, "a third one")], "id long, text string"))
    assert embed_stored(more, TrigramEmbedder(16), store, buckets=4)[1] == 1
    again, n = embed_stored(more.withColumn("vec", F.lit("clash")), TrigramEmbedder(16), store, buckets=4)
    assert n == 0 and again.count() == 34 and again.columns == ["id", "text", "vec"]
    # Another embedder has vectors of its own.
    other, n = embed_stored(df, TrigramEmbedder(8), store, buckets=4)
    assert n == 3 and {len(r["vec"]) for r in other.collect()} == {8}
