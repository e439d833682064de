import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, queries

from .conftest import ODD


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    """Rows of the contract, by comparing every window with every position."""
    windows = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta GAMMA delta, eps zeta eta theta iota kappa lambda mu"), (2, "short one"), (3, None), (4, "..."), (5, "Été 中文 x"), (12, "short one"), (7, "z z z")]
DOCS = [
    (1, None, "a"), (2, "", "a"), (3, "say: SHORT-one, short two one short one", "a"), (4, "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu", None),
    (5, "beta gamma delta eps zeta eta theta iota kappa lambda and more z z z z z", "b"), (5, "beta gamma delta eps zeta eta theta iota kappa lambda and more z z z z z", "b"),
    (6, "alpha beta gamma delta eps zeta eta theta iota", "b"), (7, "ÉTÉ 中文 x", "c"), (8, "xx ÉTé_中文-X!", "c"), (9, "clean words " * 20_000 + "short one", "c"), (None, "short One", "c"),
]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_query_equals_brute_force(spark, documents, stored, odd):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    at = stored(documents=documents(DOCS), benchmark=bench)
    assert rows(queries.op7_decontamination(spark, at)) == brute([(d, t) for d, t, _ in DOCS], ITEMS)
    at = stored(documents=odd, benchmark=bench.limit(0))
    assert rows(queries.op7_decontamination(spark, at)) == brute([(d, t) for d, t, _ in ODD], [])
    assert queries.op7_decontamination(spark, stored(documents=odd.limit(0), benchmark=bench)).count() == 0


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert any(r[-1] for r in want)
    assert rows(queries.op7_decontamination(spark, sf)) == want


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_slices_do_not_change_what_is_found(spark, documents, size):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find(documents(DOCS), bench, slice_size=size).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.item_ids)) for r in found) == sorted(
        (str(r.doc_id), r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.find(documents(DOCS), bench).collect()
    )


def test_documents_and_spans_are_removed(spark, documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(DOCS).withColumns({"spans": F.lit(1), "item_ids": F.lit("x")})
    left = decontaminate.remove_documents(documents(DOCS), bench)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 6, 7]
    texts = {r.doc_id: r.text for r in decontaminate.remove_spans(documents(DOCS), bench).collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == "say: , short two one " and texts[4] == " nu" and texts[8] == "xx !"
    assert decontaminate.find(decontaminate.remove_spans(documents(DOCS), bench), bench).filter("n_hit > 0").count() == 0
    assert decontaminate.find(docs, bench).count() == len(DOCS)


@pytest.mark.parametrize("size", [1, 1000])
def test_items_without_an_id_are_hit(spark, documents, size):
    bench = spark.createDataFrame([(None, "secret passage here"), (None, "shared words"), (3, "shared words")], "item_id long, text string")
    docs = documents([(1, "a Secret passage here, too", "s"), (2, "shared words", "s"), (3, "clean text", "s")])
    found = {r.doc_id: (r.n_hit, r.item_ids, r.unnamed_item) for r in decontaminate.find(docs, bench, slice_size=size).collect()}
    assert found == {1: (3, [], True), 2: (2, ["3"], True), 3: (0, [], False)}
    assert [r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()] == [3]


def test_items_without_an_id_equal_the_sql(spark, documents, stored):
    import duckdb

    from tools.check import compare

    bench = spark.createDataFrame([(None, "secret passage here"), (None, "shared words"), (3, "shared words")], "item_id long, text string")
    at = stored(documents=documents([(1, "a Secret passage here, too", "s"), (2, "shared words", "s"), (3, "clean text", "s")]), benchmark=bench)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{at.removeprefix('file:')}/{t}.parquet/*.parquet')")
    line, equal = compare(spark, con, "op7_decontamination", at, queries.SQL["op7_decontamination"])
    assert equal, line


def test_columns_of_documents_survive(spark):
    names = ["n_words", "n_hit", "spans", "item_ids", "unnamed_item", "_text", "n_items"]
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "clean"), (3, None), (4, "")], "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for out, texts in ((decontaminate.remove_documents(docs, items), {2: "clean", 3: None, 4: ""}), (decontaminate.remove_spans(docs, items), {1: "x  y", 2: "clean", 3: None, 4: ""})):
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == texts and all(r[c] == f"own {c}" for r in rows for c in names)


def test_many_slices_are_written_in_between(spark):
    items = spark.createDataFrame([(i, f"word{i} tail") for i in range(60)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x word{i} tail z word{i + 1} tail") for i in range(50)], "doc_id long, text string")
    got = decontaminate.find(docs, items, slice_size=6).collect()
    assert all(r.n_hit == 4 and r.item_ids == sorted([str(r.doc_id), str(r.doc_id + 1)]) for r in got) and len(got) == 50
