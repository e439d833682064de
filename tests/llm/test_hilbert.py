import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import hilbert, queries

from .conftest import ODD


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (2, 1)])
def test_curve_visits_every_cell_by_single_steps(spark, dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(dims)))
    got = df.select(hilbert.curve_index([F.col(f"c{i}") for i in range(dims)], bits).alias("h"), *df.columns).orderBy("h").collect()
    assert [r.h for r in got] == list(range(len(cells)))
    for a, b in itertools.pairwise(got):
        assert sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1


def test_size_codes_keep_order(spark):
    got = [r[0] for r in spark.range(0, 5000).select(hilbert.size_code(F.col("id"))).collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] < 64
    assert spark.sql("select cast(null as bigint) s").select(hilbert.size_code(F.col("s"))).first()[0] == 0


def check(rows, got, shards=40):
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (d is None, d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows
    )
    slots = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    ordered = [r.curve_index for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)


def test_query_on_odd_rows(spark, odd, stored):
    check(ODD, queries.op9_hilbert(spark, stored(documents=odd)).collect())
    assert queries.op9_hilbert(spark, stored(documents=odd.limit(0))).count() == 0


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = queries.op9_hilbert(spark, sf).collect()
    check([(d.doc_id, d.text) for d in docs], got)
    # A shard is narrow in each dimension: it holds few sources although all are spread over the table.
    source = {d.doc_id: d.source for d in docs}
    held = {}
    for r in got:
        held.setdefault(r.shard, set()).add(source[r.doc_id])
    assert sum(map(len, held.values())) / len(held) < 0.5 * len(set(source.values()))


def test_clashing_columns_and_files(spark, odd, tmp_path):
    docs = odd.withColumns({"slot": F.lit("x"), "shard": F.lit(-1), "rank": F.lit(1), "value": F.lit(2), "size": F.length("text")})
    out = hilbert.shard(docs, ["source", "lang"], ["size"], 3)
    assert {"rank", "value", "shard", "slot", "curve_index"} <= set(out.columns)
    hilbert.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


def test_native(spark):
    plan = queries.op9_hilbert(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shard_moves_rows_by_number_and_keeps_their_columns(spark, odd, stored):
    docs = spark.read.parquet(stored(documents=odd) + "/documents.parquet").withColumns({"size": F.lit("own"), "row": F.lit("r"), "v0": F.lit("v"), "_place": F.lit("p")})
    out = hilbert.shard(docs, ["source", "lang"], [F.length("text")], 3)
    rows = out.collect()
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s in range(3) for i in range(sum(r.shard == s for r in rows)))
    assert hilbert.shard(docs.limit(0), ["source"], ["n_chars"], 3).count() == 0
