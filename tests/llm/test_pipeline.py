import corpus_pipeline
from glyphmill.llm import queries

from . import test_decontaminate, test_mixing, test_near_dups, test_quality
from .conftest import ODD

SF = "/root/testdata/sf0.01"


def test_each_stage_takes_effect_on_what_the_one_before_kept(spark):
    """Every stage against brute force over its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: r for r in queries.op3_fertility(spark, SF).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF).cache()
        ids = sorted(r.doc_id for r in out.collect())
        texts = [(r.doc_id, r.text) for r in before]
        if name == "quality":
            assert ids == sorted(d for d, t in texts if kept[d].kept) and not any(test_quality.brute(t)[-1] for d, t in texts if d in set(ids))
        elif name == "near-duplicates":
            assert ids == sorted(r[0] for r in test_near_dups.brute(texts, corpus_pipeline.NEAR.per_cent) if r[3]) and len(ids) < len(before)
        elif name == "decontamination":
            assert ids == sorted(r[0] for r in test_decontaminate.brute(texts, items) if not r[-1]) and len(ids) < len(before)
        elif name == "mixing":
            sizes, taken, largest = {}, {}, {}
            for r in before:
                n = len(r.text.encode().split())
                sizes[r.source], largest[r.source] = sizes.get(r.source, 0) + n, max(largest.get(r.source, 0), n)
            for r in out.collect():
                taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
            want = test_mixing.targets_by_steps((5, 2, 1), 3, 2, sizes)
            assert all(abs(taken.get(s, 0) - want[s]) <= largest[s] / 2 + 1 for s in want)
            assert max(ids.count(i) for i in set(ids)) == 2 and set(ids) <= {r.doc_id for r in before}
        else:
            rows = out.collect()
            assert ids == sorted(r.doc_id for r in before)
            counts = [sum(r.shard == s for r in rows) for s in range(40)]
            assert max(counts) - min(counts) <= 1 and {r.shard for r in rows} == set(range(40))
        if name != "sharding":
            assert out.columns == docs.columns
        docs = out


def test_run_on_odd_rows(spark, odd, documents, stored):
    bench = spark.createDataFrame([(1, "no such text")], "item_id long, text string")
    fine = " ".join(f"thing{chr(97 + i % 26)}{chr(97 + i // 26)} another" for i in range(60))
    rows = ODD + [(100, fine, "a"), (101, fine.upper(), "a"), (102, fine + " and more", None)]
    out = corpus_pipeline.run(spark, stored(documents=documents(rows), benchmark=bench)).collect()
    assert {r.doc_id for r in out} == {100}
    assert corpus_pipeline.run(spark, stored(documents=odd.limit(0), benchmark=bench.limit(0))).count() == 0


def test_registered(spark):
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered

    assert registered()["pipeline"] is corpus_pipeline.run and "pipeline" not in oracle_sql()
    assert set(queries.QUERIES) <= set(registered())
