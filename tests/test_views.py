import re

from pyspark.sql import functions as F

from glyphmill import views
from glyphmill.functions import csharp, rows


def _documents(spark, tmp_path, texts):
    rows_ = [(i, t, "en", "web", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_lines_of_sources_are_cleaned_once_a_text(spark, tmp_path):
    texts = ["a-b, c\n\ndあ\U0001f600e{\n\"x\"\r\n", "", None, "\n", "plain"]
    made = views.sources(spark, _documents(spark, tmp_path, texts))
    assert "regexp_replace(lambda" not in made._jdf.queryExecution().analyzed().toString()
    for text, row in zip(texts, made.orderBy("doc_id").collect(), strict=True):
        if text is None:
            assert row["text"] is None
            continue
        said = [re.sub("[^A-Za-z0-9 ]", "", line) for line in text.split("\n")]
        assert re.findall(r"<summary>(\d+)</summary>", row["text"]) == [str(i) for i in range(len(said))]
        assert re.findall(r'\{names\["\{"\]\}", "(.*?) \{"\); \}', row["text"]) == said[0::3]
        assert re.findall(r'Make\(a, "(.*?)"\);', row["text"]) == said[1::3]


def test_brackets_are_counted_without_a_string_for_each_character(spark):
    found = spark.createDataFrame([("class A { void M(int[] a) { f(); } }",)], "text string").select(csharp.method_spans(csharp.pieces(F.col("text"))).alias("s"))
    assert "translate(" not in found._jdf.queryExecution().analyzed().toString()
    counted = spark.createDataFrame([("([x)]((",), ("",), (None,)], "text string").select(csharp._count(F.col("text"), "([").alias("n"))
    assert [r["n"] for r in counted.collect()] == [4, 0, None]


def test_a_scan_is_dealt_into_several_tasks_a_core(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 1000, numPartitions=cores + 1).write.parquet(f"{tmp_path}/few")
    scan = spark.read.parquet(f"{tmp_path}/few")
    dealt = rows.spread(scan, "id")
    assert dealt.rdd.getNumPartitions() == 4 * cores
    assert dealt.count() == 1000
    wide = spark.range(0, 4 * cores, numPartitions=4 * cores)
    assert rows.spread(wide, "id") is wide
