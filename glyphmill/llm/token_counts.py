"""Token counts through a cache keyed by content digest and tokenizer version."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import vocab
from glyphmill.llm.common import arrow_stage

_CACHED = "digest binary, n_tokens long"


def _counter(name: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name.endswith(".model"):
            processor = vocab.pieces(name)
            lengths = lambda texts: [len(processor.encode(t)) for t in texts]
        else:
            bpe = vocab.byte_bpe(name)
            lengths = lambda texts: [len(ids) // 4 for ids in bpe.encode(texts)]
        for batch in batches:
            texts = (t.as_py().decode("utf-8", "replace") for t in batch.column(1))
            counts = [n for group in vocab.in_groups(texts, len) for n in lengths(group)]
            yield pa.record_batch([batch.column(0).cast(pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def cached(spark, cache: str, tokenizer: str) -> DataFrame:
    """What the cache holds for a tokenizer's version, one row per digest."""
    at = f"{cache}/tokenizer={vocab.version(tokenizer)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _CACHED)
    # Two runs may have added the same digest at the same time.
    return spark.read.schema(_CACHED).parquet(at).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, text: str = "text", normal: Callable[[Column], Column] | None = None, limit: int = 4096
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; new contents are encoded once and added to ``cache``.

    ``cache`` is a folder that driver and executors share. Content is what the tokenizer sees: null counts as empty, and
    ``normal`` may map a text to another with the same tokens. Every distinct content that the cache lacks is encoded
    once, however often it occurs: copies meet in an aggregate that combines before the shuffle. The counts
    return to the rows by digest, so texts move once and only on the way to the encoder.
    Equal rows get equal counts, an empty table adds nothing, columns of ``docs`` with the new names are replaced.
    """
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    content = F.coalesce(F.col(text), F.lit(""))
    content = (normal(content) if normal else content).cast("binary")
    digest = F.unhex(F.sha2(content, 256))
    spark = docs.sparkSession
    distinct = docs.select(digest.alias("digest"), content.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(cached(spark, cache, tokenizer), "digest", "left_anti")
    at = f"{cache}/tokenizer={vocab.version(tokenizer)}"
    arrow_stage(misses.select("digest", "content"), _counter(tokenizer), _CACHED).write.mode("append").parquet(at)
    counted = cached(spark, cache, tokenizer).withColumnRenamed("digest", "_digest")
    n_bytes = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    rows = docs.withColumns({"n_bytes": n_bytes, "_digest": digest})
    return rows.join(counted, "_digest").drop("_digest").withColumn("over_limit", F.col("n_tokens") > limit)
