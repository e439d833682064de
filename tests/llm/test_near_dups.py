import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.llm import near_dups, queries
from glyphmill.llm.components import connected

from .conftest import ODD


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, per_cent=85):
    """``doc_id, n_shingles, component_id, kept`` by comparing all pairs."""
    found = [(d, sets(t)) for d, t in rows]
    group = list(range(len(found)))
    for i, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:i]):
            if a and b and 100 * len(a & b) >= per_cent * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    smallest = {}
    for (d, _), g in zip(found, group):
        smallest[g] = d if smallest.get(g) is None else min(smallest[g], smallest[g] if d is None else d)
    return sorted(((d, len(s), smallest[g], d == smallest[g]) for (d, s), g in zip(found, group)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def planted(seed=1):
    """Groups around a base with more and more edits, so that links chain, at the edge of the threshold and below it."""
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 6, 40, 150, 400]))]
        for k in range(12):
            out.append(edited(rng, base, rng.randrange(0, 2 + len(base) // 150)))
            base = edited(rng, base, k % 3 == 2).split(" ")
    out += ["Short Text", "short text", "short  TEXT\n", "other text", "a b c d e", "A B C D E f", "é É x y z q"]
    rng.shuffle(out)
    return list(enumerate(out))


def test_components_equal_all_pairs(spark, documents):
    rows = planted()
    want = brute(rows)
    docs = documents([(d, t, "s") for d, t in rows])
    assert rows_of(near_dups.near_duplicates(docs)) == want
    assert sum(not r[3] for r in want) > 30
    # Small bounds make rows look back at few others, over many chunks, and regions have many blocks.
    tight = near_dups.Forest(trees=40, crowd=4, block=3, block_shingles=500)
    assert rows_of(near_dups.near_duplicates(docs, tight)) == want


def test_query_on_odd_rows(spark, odd, stored):
    want = brute([(d, t) for d, t, _ in ODD])
    assert rows_of(queries.op6_lsh_forest(spark, stored(documents=odd))) == want
    assert queries.op6_lsh_forest(spark, stored(documents=odd.limit(0))).count() == 0


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op6_lsh_forest(spark, sf)) == brute(docs)


def linked(rows, per_cent=85):
    """All pairs that link, exactly: two sets that link share one of their rarest shingles."""
    found = {d: sets(t) for d, t in rows}
    counts = Counter(s for found_in in found.values() for s in found_in)
    number = {s: i for i, (s, _) in enumerate(sorted(counts.items(), key=lambda c: c[1]))}
    posted, pairs = defaultdict(list), set()
    ordered = {d: sorted(map(number.get, f)) for d, f in found.items() if f}
    for d, mine in sorted(ordered.items(), key=lambda o: len(o[1])):
        rare = mine[: len(mine) - -(-per_cent * len(mine) // 100) + 1]
        met = {e for s in rare for e in posted[s] if 100 * len(ordered[e]) >= per_cent * len(mine)}
        a = found[d]
        pairs |= {(d, e) for e in met if 100 * len(a & found[e]) >= per_cent * len(a | found[e])}
        for s in rare:
            posted[s].append(d)
    return pairs


def test_recall_over_a_larger_table(spark):
    """No link of the 10,000 documents is lost, and none is made up."""
    sf = "/root/testdata/sf0.1"
    pairs = linked([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    name = {r.doc_id: r.component_id for r in queries.op6_lsh_forest(spark, sf).select("doc_id", "component_id").collect()}
    assert len(pairs) > 500 and all(name[a] == name[b] for a, b in pairs)
    least = {d: d for d in name}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert least == name


def test_crowded_orders_compare_few_pairs():
    """A stretch of rows that share their first values: each row looks back at ``crowd`` rows and not at the whole stretch."""
    rng = np.random.default_rng(3)
    signs = rng.integers(0, 1 << 16, (600, 24)).astype("<u2")
    signs[:, : near_dups.LEAST] = 7
    signs[300:] = signs[299]
    order = sorted(range(600), key=lambda i: (signs[i].tobytes(), i))
    rows = pa.table({"node": pa.array(order, pa.int64()), "tree": pa.array([0] * 600, pa.int32()), "turned": [signs[i].tobytes() for i in order]})
    links = list(near_dups._neighbours(72, 5)(rows))
    assert len(links) == 300 and {n for link in links for n in link} == set(range(299, 600))
    # Other trees and other beginnings are never compared.
    apart = rows.set_column(1, "tree", pa.array(range(600), pa.int32()))
    assert list(near_dups._neighbours(0, 5)(apart)) == []


def test_one_of_each_group_stays(spark, documents):
    rows = planted(2)
    docs = documents([(d, t, "s") for d, t in rows]).withColumns({"digest": F.lit("x"), "node": F.lit(1), "component": F.lit(2)})
    left = near_dups.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_rows_are_decided_by_themselves(spark, documents):
    """Null ids, and ids that different texts share, do not carry a decision over to other rows."""
    rng = random.Random(9)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(6))
    # A copy without id beside unrelated texts without id; copies that all lack one; one id with two texts, each linked elsewhere or not; one row twice.
    rows = [(1, a), (None, a.upper()), (None, b), (None, None), (None, c), (None, c), (2, d), (2, e), (3, e), (0, d), (4, f), (4, f), ((1 << 63) - 1, "alone here")]
    docs = documents([(i, t, "s") for i, t in rows])
    assert rows_of(near_dups.near_duplicates(docs)) == brute(rows)
    left = [(r.doc_id, r.text) for r in near_dups.deduplicate(docs).collect()]
    want = [(1, a), (None, b), (None, None), (None, c), (2, e), (0, d), (4, f), ((1 << 63) - 1, "alone here")]
    assert sorted(left, key=str) == sorted(want, key=str)


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1400)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(180)] + [(5, 5), (7, 6), (6, 7)]
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    group = {n: n for e in edges for n in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    assert got == group
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
