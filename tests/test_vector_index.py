import numpy as np
import pytest

from glyphmill.operators.vector_index import build
from tests.test_retrieval import brute, clustered, found, frames


def cosine(queries, known, k):
    def unit(v):
        return np.array(v) / (np.linalg.norm(v) or 1)

    out = []
    for q, v in queries:
        scored = sorted((round(((unit(v) - unit(w)) ** 2).sum(), 9), i) for i, w in known)
        out += [(q, r + 1, i) for r, (_, i) in enumerate(scored[:k])]
    return out


def share(got, want):
    pairs = {(q, i) for q, _, i in want}
    return len({(q, i) for q, _, i in got} & pairs) / len(pairs)


def test_recall_and_less_work_than_all_pairs(spark):
    queries, known = clustered(1, 50), clustered(2, 1500)
    asked, rows = frames(spark, queries, known)
    index = build(rows)
    assert index.rows.count() == 1500 and index.sizes.agg({"n": "sum"}).first()[0] == 1500
    hits, compared = index.search(asked, 5)
    assert share(found(hits), brute(queries, known, 5)) >= 0.9
    assert compared < 50 * 1500 / 2


@pytest.mark.parametrize("metric, model", [("euclidean", brute), ("cosine", cosine)])
def test_all_probes_are_exact(spark, metric, model):
    queries, known = clustered(3, 30), clustered(4, 300)
    asked, rows = frames(spark, queries, known)
    index = build(rows, metric=metric, cells=12, block_rows=16)
    hits, compared = index.search(asked, 4, probes=12, group_rows=5)
    assert found(hits) == model(queries, known, 4) and compared == 30 * 300


def test_cosine_distances(spark):
    asked, rows = frames(spark, [(1, [2.0, 0.0])], [(1, [5.0, 0.0]), (2, [0.0, 3.0]), (3, [-1.0, 0.0])])
    hits, _ = build(rows, metric="cosine", cells=1).search(asked, 3)
    assert [(r["known_id"], round(r["distance"], 9)) for r in hits.orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]
    with pytest.raises(ValueError):
        build(rows, metric="hamming")


def test_a_third_of_the_rows_are_copies(spark):
    """Their cell is cut into blocks of bounded size, and ties come by id."""
    known = clustered(5, 400) + [(1000 + i, clustered(5, 1)[0][1]) for i in range(200)]
    queries = [(i, clustered(5, 1)[0][1]) for i in range(40)]
    asked, rows = frames(spark, queries, known)
    index = build(rows, block_rows=32)
    assert index.rows.groupBy("cell", "block").count().agg({"count": "max"}).first()[0] <= 48
    hits, _ = index.search(asked, 6, group_rows=7)
    assert found(hits) == brute(queries, known, 6)


def test_odd_rows(spark):
    """Rows without a vector, repeated query ids, fewer rows than asked for, no rows at all."""
    asked, rows = frames(spark, [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, None)], [(7, [1.0, 0.0]), (8, None), (9, [0.0, 2.0])])
    hits, _ = build(rows).search(asked, 5, probes=9)
    assert found(hits) == [(1, 1, 7), (1, 1, 7), (1, 2, 9), (1, 2, 9)]
    empty, compared = build(rows.limit(0)).search(asked, 5)
    assert empty.count() == 0 and compared == 0
    assert build(rows).search(asked.limit(0), 5)[0].count() == 0
