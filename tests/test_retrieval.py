import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.embedding import Embedder, TrigramEmbedder
from glyphmill.operators.retrieval import attach_history, embed, nearest, salted


def brute(queries, known, k):
    """All distances, ranked by the rounded value and then by id."""
    out = []
    for q, v in queries:
        scored = sorted((round(sum((a - b) ** 2 for a, b in zip(v, w)), 9), i) for i, w in known)
        out += [(q, r + 1, i) for r, (_, i) in enumerate(scored[:k])]
    return out


def frames(spark, queries, known):
    return (
        spark.createDataFrame(queries, "query_id long, vec array<double>"),
        spark.createDataFrame(known, "known_id long, vec array<double>"),
    )


def found(hits):
    return [(r["query_id"], r["rank"], r["known_id"]) for r in hits.orderBy("query_id", "rank").collect()]


def clustered(seed, n, dim=8, clusters=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim)) * 5
    points = centers[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim))
    return [(i, [float(x) for x in p]) for i, p in enumerate(points)]


WAYS = [{}, {"max_local_bytes": 0, "group_bytes": 1000, "block_rows": 16}]


@pytest.mark.parametrize("how", WAYS)
def test_nearest_equals_brute_force(spark, how):
    queries, known = clustered(1, 60), clustered(2, 300)
    assert found(nearest(*frames(spark, queries, known), 5, **how)) == brute(queries, known, 5)


@pytest.mark.parametrize("how", WAYS)
def test_a_third_of_all_rows_may_be_copies(spark, how):
    known = clustered(3, 200)
    known += [(1000 + i, known[0][1]) for i in range(100)]
    queries = [(i, known[0][1]) for i in range(40)] + [(100 + i, v) for i, v in known[:20]]
    assert found(nearest(*frames(spark, queries, known), 7, **how)) == brute(queries, known, 7)


@pytest.mark.parametrize("how", WAYS)
def test_fewer_known_than_asked_for_and_none(spark, how):
    queries, known = clustered(4, 5), clustered(5, 3)
    assert found(nearest(*frames(spark, queries, known), 10, **how)) == brute(queries, known, 10)
    assert found(nearest(*frames(spark, queries, []), 3, **how)) == []


def test_no_vector_is_shuffled(spark):
    queries, known = clustered(6, 50), clustered(7, 500)
    hits = nearest(*frames(spark, queries, known), 3, max_local_bytes=0, block_rows=64)
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    assert found(hits) == brute(queries, known, 3)


def test_what_a_task_holds_does_not_grow_with_the_known_rows():
    import tracemalloc

    from glyphmill.operators.retrieval import _ranked

    def peak(n):
        vectors = np.random.default_rng(n).normal(size=(n, 4))
        ids = np.arange(n)
        tracemalloc.start()
        _ranked(vectors[:1024], vectors, ids, 5)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top - 5 * vectors.nbytes  # what is linear in the block

    assert peak(64_000) < 1.5 * peak(8_000)


@pytest.mark.parametrize("shift, scale", [(0, 1), (1e6, 1), (0, 1e-14), (0, 1e30), (0, 0)])
def test_tiles_and_blocks_equal_brute_force(shift, scale):
    from glyphmill.operators.retrieval import _ranked

    vectors = np.round(np.random.default_rng(8).normal(size=(5000, 3)), 1) * scale + shift
    ids = np.random.default_rng(9).permutation(len(vectors))
    asked, best = vectors[:600] + scale / 7, None
    for at in range(0, len(ids), 1999):
        best = _ranked(asked, vectors[at : at + 1999], ids[at : at + 1999], 4, best)
    whole = _ranked(asked, vectors, ids, 4)
    for i, q in enumerate(asked):
        far = np.round(((vectors - q) ** 2).sum(axis=1), 9)
        want = np.lexsort((ids, far))[:4]
        assert (best[0][i] == ids[want]).all() and (whole[0][i] == ids[want]).all() and (whole[1][i] == far[want]).all()


def test_a_large_search_is_dealt_over_tasks_and_copies_are_left_out(spark, monkeypatch):
    from glyphmill.operators import retrieval

    queries, known = clustered(6, 50), clustered(7, 500)
    known += [(5000 + i, known[9][1]) for i in range(300)]
    monkeypatch.setattr(retrieval, "PAIRS_PER_TASK", 50 * 503 // 9)
    asked, rows = frames(spark, queries, known)
    assert retrieval._first_copies(rows, 3).count() == 502
    hits = nearest(asked.coalesce(1), rows, 3, max_local_bytes=0)
    assert hits.rdd.getNumPartitions() == 9 and found(hits) == brute(queries, known, 3)


def test_the_driver_collects_few_of_the_known_pairs(spark):
    """What is sent passes the driver, where rows of doubles take several times their size: 8 MB at most."""
    from glyphmill.operators.retrieval import MAX_LOCAL_BYTES
    from glyphmill.plans.translation import Translation

    assert Translation(None, "/", "/").max_local_bytes == MAX_LOCAL_BYTES <= 8 << 20


def test_trigrams(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",), ("abcabc",), ("日本語😀x",)], "text string")
    got = [np.array(r["vec"]) for r in embed(df, TrigramEmbedder(16)).collect()]
    assert np.allclose([np.linalg.norm(v) for v in got], [1, 0, 0, 1, 1])
    expected = np.zeros(16)
    for a, b, c in ("abc", "bcd"):
        expected[(961 * ord(a) + 31 * ord(b) + ord(c)) % 16] += 1
    assert np.allclose(got[0], expected / np.linalg.norm(expected))


class CountingEmbedder(Embedder):
    """How many texts came together."""

    def load(self):
        return lambda texts: [[float(len(texts)), float(len(t))] for t in texts]


def test_few_texts_are_strings_at_a_time(spark):
    texts = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") != 7, F.repeat(F.lit("x"), (F.col("id") % 5).cast("int"))).alias("text"))
    rows = embed(texts, CountingEmbedder()).collect()
    assert len(rows) == 3000 and max(r["vec"][0] for r in rows) <= 256
    assert all(r["vec"][1] == (r["id"] % 5 if r["id"] != 7 else 0) for r in rows)


class LengthEmbedder(Embedder):
    def load(self):
        return lambda texts: [[float(len(t))] for t in texts]


PAIRS = [(1, "grey horses run", "One"), (2, "nine blue parrots whistle loudly", "Two"), (3, "x", "Three")]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_history_of_pieces(spark, limit):
    known = spark.createDataFrame(PAIRS, "id long, source string, target string")
    pieces = spark.createDataFrame([("a", "nine blue parrots whistle"), ("b", "y"), ("c", None)], "path string, code string")
    got = attach_history(pieces, known, TrigramEmbedder(), 1, "${SOURCE}=${TARGET}", "ok", max_local_bytes=limit)
    rows = {r["path"]: [tuple(m) for m in r["history"]] for r in got.collect()}
    assert rows["a"] == [("user", "nine blue parrots whistle loudly=Two"), ("assistant", "ok")]
    assert rows["c"] == []
    two = attach_history(pieces, known, LengthEmbedder(), 2, "${TARGET}", "ok", max_local_bytes=limit)
    rows = {r["path"]: [m["content"] for m in r["history"]] for r in two.collect()}
    assert rows["a"] == ["Two", "ok", "One", "ok"]
    assert rows["b"] == ["Three", "ok", "One", "ok"]


def test_no_pairs_no_history(spark):
    pieces = spark.createDataFrame([("a", "x")], "path string, code string")
    none = spark.createDataFrame([], "id long, source string, target string")
    for known in (None, none):
        got = attach_history(pieces, known, TrigramEmbedder(), 2, "u", "a")
        assert got.select(F.size("history")).first()[0] == 0


def test_an_example_near_everything_is_spread(spark):
    """Of all hits two thirds are one example's; no group of rows that share a key has more than twice the share of a part."""
    hits = spark.range(3000).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") + 10).alias("known_id"))
    texts = spark.range(3100).select(F.col("id").alias("known_id"), F.concat(F.lit("t"), "id").alias("source"))
    left, right = salted(hits, texts, parts=30)
    assert left.groupBy("known_id", "salt").count().agg({"count": "max"}).first()[0] <= 200
    assert right.filter("known_id = 7").count() == 20 and right.count() == 3100 + 19
    joined = left.join(right, ["known_id", "salt"])
    assert joined.count() == 3000 and joined.select("query_id").distinct().count() == 3000
    assert joined.filter("source != concat('t', known_id)").count() == 0
