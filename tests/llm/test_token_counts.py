import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from glyphmill.llm import queries, token_counts, vocab
from glyphmill.scratch import scratch_dir

from .conftest import ODD


def brute(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(library.encode(t))
    library = tokenizers.Tokenizer.from_file(path)
    return lambda t: len(library.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_equal_the_library(spark, odd, name):
    count = brute(name)
    got = token_counts.count_tokens(odd.withColumn("n_tokens", odd.doc_id), name, scratch_dir(spark, "c"), limit=3).collect()
    want = sorted(((d, t, len((t or "").encode()), count(t or "")) for d, t, _ in ODD), key=str)
    assert sorted(((r.doc_id, r.text, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)


def test_cache_keeps_distinct_contents_and_only_misses_are_encoded(spark, documents, monkeypatch):
    cache, name = scratch_dir(spark, "c"), "piece_bpe_32k.model"
    docs = documents([(1, "a b", "s"), (2, "a b", "s"), (3, None, "s"), (4, "", "s")])
    assert token_counts.count_tokens(docs, name, cache).count() == 4
    at = f"{cache}/tokenizer={vocab.version(name)}"
    first = {bytes(r.digest): r.n_tokens for r in spark.read.parquet(at).collect()}
    assert len(first) == 2 == spark.read.parquet(at).count()
    more = docs.union(documents([(5, "c", "s"), (6, "a b", "s")]))
    assert token_counts.count_tokens(more, name, cache).count() == 6
    assert spark.read.parquet(at).count() == 3
    # A stored count is used as it is: nothing known is encoded again.
    spark.createDataFrame([(k, 77) for k in first], "digest binary, n_tokens long").write.mode("overwrite").parquet(at)
    assert {r.n_tokens for r in token_counts.count_tokens(docs, name, cache).collect()} == {77}


def test_empty_table(spark, documents):
    assert token_counts.count_tokens(documents([]), "piece_bpe_32k.model", scratch_dir(spark, "c")).count() == 0


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    count = brute("piece_bpe_32k.model")
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(d.text.encode()), count(d.text), count(d.text) > 4096)
