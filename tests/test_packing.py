import random
import re

from pyspark.sql import functions as F

from glyphmill.functions.packing import counted_ranges, pack, pack_by_chars
from glyphmill.functions.tokens import CharCounter, EncodedCounter, RunCounter, TokenizerFileCounter
from glyphmill.operators.segmenting import plan_pieces


class WordCounter(EncodedCounter):
    """Counts that do not add up: runs of letters, which joining can merge."""

    def load(self):
        return lambda text: len(text.split())


def model(units, limit, size=len):
    out, held = [], ""
    for unit in units:
        if size(held + "\n\n" + unit) < limit:
            held += "\n\n" + unit
        else:
            out.append(held)
            held = unit
    return out + [held] * bool(held)


def groups(seed, n=80):
    r = random.Random(seed)
    return [["x" * r.choice([0, 1, 5, 30, 120]) + " y" * r.randrange(3) for _ in range(r.randrange(12))] for _ in range(n)]


def packed(spark, units, expression):
    df = spark.createDataFrame(list(enumerate(units)), "i int, u array<string>")
    return [r["b"] for r in df.select("i", expression(F.col("u")).alias("b")).orderBy("i").collect()]


def test_packing_by_characters(spark):
    units = groups(1)
    for limit in (1, 10, 64, 200):
        assert packed(spark, units, lambda u: pack_by_chars(u, limit)) == [model(g, limit) for g in units]


def test_first_unit_too_large_sends_an_empty_batch(spark):
    assert packed(spark, [["a" * 50, "b"]], lambda u: pack_by_chars(u, 20)) == [["", "a" * 50, "b"]]
    assert packed(spark, [["a" * 50, "b"]], lambda u: pack(u, CharCounter(), 20, drop_empty=True)) == [["a" * 50, "b"]]
    assert packed(spark, [[]], lambda u: pack_by_chars(u, 20)) == [[]]


def test_packing_by_a_counter(spark):
    units = groups(2)
    words = lambda s: len(s.split())
    for limit in (1, 2, 4, 9):
        assert packed(spark, units, lambda u: pack(u, WordCounter(), limit)) == [model(g, limit, words) for g in units]


def test_batches_are_counted_only_near_their_ends():
    calls = []

    def count(text):
        calls.append(text)
        return len(text)

    assert counted_ranges(["abcd"] * 1000, count, 600)[:2] == [(0, 99), (99, 199)]
    assert len(calls) < 1000 + 60


def test_no_limit_is_one_batch(spark):
    assert packed(spark, [["a", "b"]], lambda u: pack(u, CharCounter(), None)) == [["\n\na\n\nb"]]


def test_tokens_of_a_tokenizer_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    tok = Tokenizer(models.BPE(unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    texts = ["the cat sat on the mat", "a cat and a mat", "", "unseen zzz"]
    tok.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=40, special_tokens=["?"]))
    path = str(tmp_path / "tokenizer.json")
    tok.save(path)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", TokenizerFileCounter(path).count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [len(tok.encode(t).ids) for t in texts]
    chars = df.select("i", CharCounter().count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in chars] == [len(t) for t in texts]


def test_pieces_of_whole_cut_and_unreadable_files(spark):
    code = "class A\n{\n    void F() { One(); }\n    void G() { Two(); }\n}"
    rows = [("fits", "class B { }", None), ("cut", code, None), ("bad", None, "file is empty")]
    df = spark.createDataFrame(rows, "path string, text string, error string")
    got = plan_pieces(df, CharCounter(), 30).orderBy("path", "piece_ix").collect()
    assert [(r["path"], r["kind"], r["piece_ix"], r["error"]) for r in got] == [
        ("bad", None, None, "file is empty"),
        ("cut", "class_only", 0, None),
        ("cut", "methods_only", 1, None),
        ("cut", "methods_only", 2, None),
        ("fits", "full", 0, None),
    ]
    assert [r["code"] for r in got[2:]] == ["\n\nvoid F() { One(); }", "void G() { Two(); }", "class B { }"]
    # Strictly below the limit.
    edge = spark.createDataFrame([("p", "x" * 30)], "path string, text string")
    assert plan_pieces(edge, CharCounter(), 31).first()["kind"] == "full"
    assert plan_pieces(edge, CharCounter(), 30).first()["kind"] == "class_only"


def runs(text):
    return len(re.findall(r"[ \t\n\r]+|[0-9A-Za-z]+|[^ \t\n\r0-9A-Za-z]+", text))


def test_packing_by_runs_equals_counting_whole_batches(spark):
    """Joining merges white space at the ends of units; empty units, and units of white space alone, vanish in it."""
    r = random.Random(7)
    parts = ["", " ", "\n", "a", "ab 12", "é!", "x\n", "\ny", "日本 z", "#", "w" * 9]
    units = [["".join(r.choice(parts) for _ in range(r.randrange(6))) for _ in range(r.randrange(14))] for _ in range(120)]
    for limit in (1, 2, 6, 15, 60):
        got = packed(spark, units, lambda u: pack(u, RunCounter(), limit))
        assert got == [model(u, limit, runs) for u in units]


def test_summaries_join_like_texts(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(" \nab1é#") for _ in range(r.randrange(5))) for _ in range(300)]
    df = spark.createDataFrame(list(zip(texts, reversed(texts))), "a string, b string")
    c = RunCounter()
    one, two = c.joined(c.summary(F.col("a")), c.summary(F.col("b"))), c.summary(F.concat("a", "b"))
    for row in df.select("a", "b", one.alias("one"), two.alias("two")).collect():
        assert row["one"] == row["two"] and row["two"]["n"] == runs(row["a"] + row["b"])
