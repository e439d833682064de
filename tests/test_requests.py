from pyspark.sql import functions as F

from glyphmill.operators import requests as R


def one(spark, column, rows=None, schema="user string"):
    df = spark.createDataFrame(rows or [("q",)], schema)
    return df.select(column.alias("o")).first()["o"]


def said(*messages):
    return F.array(*[R.message(role, F.lit(text)) for role, text in messages])


def test_prompts_are_filled_literally(spark):
    rows = [("full", "a ${CODE} $1 \\ b"), ("empty", "x"), ("missing", "x"), (None, None)]
    df = spark.createDataFrame(rows, "kind string, code string")
    got = R.render_prompt(df, {"full": "<${CODE}|${OTHER}>", "empty": ""}).collect()
    assert got[0]["user"] == "<a ${CODE} $1 \\ b|${OTHER}>" and got[0]["error"] is None
    assert [g["error"] for g in got[1:]] == ["prompt 'empty' is not defined", "prompt 'missing' is not defined", None]
    assert [g["user"] for g in got[1:]] == [None, None, None]


def test_earlier_errors_stay(spark):
    df = spark.createDataFrame([("missing", "x", "file is empty")], "kind string, code string, error string")
    assert R.render_prompt(df, {}).first()["error"] == "file is empty"


def test_examples_in_order_and_replacement_order(spark):
    examples = F.array(
        F.struct(F.lit("print 1").alias("source"), F.lit("echo 1").alias("target")),
        F.struct(F.lit("has ${TARGET}").alias("source"), F.lit("Two").alias("target")),
    )
    got = one(spark, R.example_messages(examples, "${SOURCE} -> ${TARGET}", "fine"))
    assert [tuple(m) for m in got] == [
        ("user", "print 1 -> echo 1"), ("assistant", "fine"),
        ("user", "has Two -> Two"), ("assistant", "fine"),
    ]


def test_chat_messages(spark):
    history = said(("user", "u1"), ("assistant", "a1"))
    full = one(spark, R.assemble_messages(F.col("user"), F.lit("rules"), history))
    assert [tuple(m) for m in full] == [("system", "rules"), ("user", "u1"), ("assistant", "a1"), ("user", "q")]
    bare = one(spark, R.assemble_messages(F.col("user")))
    assert [tuple(m) for m in bare] == [("user", "q")]
    nothing = one(spark, R.assemble_messages(F.col("user"), F.lit(""), F.lit(None).cast(R.HISTORY)))
    assert [tuple(m) for m in nothing] == [("user", "q")]


def test_flat_prompt(spark):
    history = said(("user", "u1"), ("assistant", "a1"))
    flat = one(spark, R.flatten_messages("<${PROMPT}>", F.col("user"), F.lit("rules"), history))
    assert flat == (
        "<Remember these rules:\nrules\n>\nCertainly, I will remember and follow these rules.\n"
        "<\nu1\n>\na1\n<\nq\n>"
    )
    assert one(spark, R.flatten_messages("<${PROMPT}>", F.col("user"))) == "<\nq\n>"
