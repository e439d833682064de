import random

from pyspark.sql import functions as F

from glyphmill.llm import mixing, queries
from glyphmill.llm.common import word_count

from .conftest import ODD


def targets_by_steps(weights, halves, cap, sizes):
    """Water poured by weight in small steps, to check the closed form."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * sizes[s], mid * w[s]) for s in order) < halves * sum(sizes.values()) / 2 else (low, mid)
    return {s: min(cap * sizes[s], high * w[s]) for s in order}


def test_targets():
    rng = random.Random(1)
    for _ in range(200):
        sizes = {s: rng.randrange(0, 1000) for s in rng.sample(["a", "b", "é", "z", "\U0001f600", "", None], rng.randrange(1, 8))}
        got = mixing.Weights().targets(sizes)
        want = targets_by_steps((5, 2, 1), 3, 2, sizes)
        assert all(abs(got[s] - want[s]) < 1e-3 for s in sizes), (sizes, got, want)
        assert all(got[s] <= 2 * sizes[s] for s in sizes)
    assert mixing.Weights().targets({"a": 0}) == {"a": 0.0}


def cost(patterns, flow):
    """Cost of a routing: the k-th copy of a pattern costs k squared a token."""
    out = 0
    for p, (tokens, _) in patterns.items():
        given = sum(n for (q, _), n in flow.items() if q == p)
        k = 1
        while given > 0:
            out += k * k * min(given, tokens)
            given, k = given - tokens, k + 1
    return out


def best(patterns, quotas, copies):
    """Largest value and its least cost, over all routings of small integers, token by token."""
    states = {(tuple([0] * len(patterns)), tuple([0] * len(quotas)))}
    reached = set(states)
    names, sources = list(patterns), list(quotas)
    while states:
        states = {
            (tuple(x + (i == a) for i, x in enumerate(f)), tuple(x + (i == b) for i, x in enumerate(g)))
            for f, g in states
            for a, p in enumerate(names)
            for b, s in enumerate(sources)
            if s in patterns[p][1] and f[a] < copies * patterns[p][0] and g[b] < quotas[s]
        }
        reached |= states
    top = max(sum(f) for f, _ in reached)
    return top, min(cost(patterns, {(p, 0): n for p, n in zip(names, f)}) for f, _ in reached if sum(f) == top)


def test_flow_is_largest_and_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        patterns = {"".join(s): (rng.randrange(0, 3), s) for s in [("a",), ("a", "b"), ("b", "c"), ("c",)] if rng.random() < 0.8}
        quotas = {s: rng.randrange(0, 4) for s in "abc"}
        flow = mixing.route(patterns, quotas, 2)
        assert all(n >= 0 and s in patterns[p][1] for (p, s), n in flow.items())
        for s in quotas:
            assert sum(n for (_, x), n in flow.items() if x == s) <= quotas[s]
        if patterns:
            assert (sum(flow.values()), cost(patterns, flow)) == best(patterns, quotas, 2)


def check(rows, got):
    sizes, order = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    targets = mixing.Weights().targets(sizes)
    assert len(got) == len(rows)
    for d, t, s in rows:
        order.setdefault((d, len((t or "").encode().split()), sizes[s], targets[s]), 0)
    assert {(r.doc_id, r.size, r.source_size, r.target) for r in got} == set(order)
    assert all(r.taken % r.size == 0 and r.taken <= 2 * r.size if r.size else r.taken == 0 for r in got)


def test_query_on_odd_rows(spark, odd, stored):
    at = stored(documents=odd)
    got = queries.op10_min_cost_flow(spark, at).collect()
    check(ODD, got)
    assert sorted(map(str, got)) == sorted(map(str, queries.op10_min_cost_flow(spark, at).collect()))
    assert queries.op10_min_cost_flow(spark, stored(documents=odd.limit(0))).count() == 0


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_min_cost_flow(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check([(d.doc_id, d.text, d.source) for d in docs], got)
    source = {d.doc_id: d.source for d in docs}
    taken, target, largest = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        taken[s], target[s], largest[s] = taken.get(s, 0) + r.taken, r.target, max(largest.get(s, 0), r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in taken)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"], "w " * (i % 7 + 1), "old", 1, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, text string, key string, whole int, cut string")
    out = mixing.mix(docs, F.col("sources"), word_count(F.col("text")), mixing.Weights((1, 3), halves=2))
    assert out.columns == docs.columns
    counts = [r["count"] for r in out.groupBy("doc_id").count().collect()]
    total = sum(i % 7 + 1 for i in range(600))
    assert max(counts) <= 2 and abs(out.agg(F.sum(word_count(F.col("text")))).first()[0] - total) <= 12
    assert mixing.mix(docs.limit(0), F.col("sources"), word_count(F.col("text")), mixing.Weights()).count() == 0


def test_targets_of_many_sources_equal_the_closed_form(spark):
    rng = random.Random(4)
    for names in (["a", "b", "é", "z", "\U0001f600", "", None], [f"s{i}" for i in range(200)], ["one"], []):
        sizes = {s: rng.randrange(0, 1000) for s in names}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows, mixing.Weights(), sum(sizes.values())).collect()}
        assert got == mixing.Weights().targets(sizes) if sizes else got == {}


def test_more_sources_than_the_flow_would_take(spark):
    """A source a row, and one source that holds many rows: none of them needs the flow."""
    n = 300_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source"), F.lit("two words").alias("text"))
    out = mixing.mix(docs, F.array("source"), word_count(F.col("text")), mixing.Weights())
    total = out.select(word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    # Targets of single documents are rounded to whole documents.
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert n < total <= 2 * n * 2


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    rows = [(None if i % 2 else i, f"text number {i}", "big" if i % 5 else "small") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {"big": 320 * 3, "small": 80 * 3}
    taken = {r.source: 3 * r["count"] for r in mixing.mix(docs, F.array("source"), word_count(F.col("text")), mixing.Weights()).groupBy("source").count().collect()}
    want = mixing.Weights().targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
