"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes the rows that the one before kept. Null texts, empty tables, repeated rows and columns of any name pass as the
operators in ``glyphmill.llm`` define; all stages but the last leave the columns of ``docs`` as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, hilbert, mixing, near_dups, quality
from glyphmill.llm.common import table, word_count
from glyphmill.scratch import cleaned, remove, scratch_dir, watched

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near-duplicates link from 80 per cent; 32 trees miss 1 in 20,000 pairs at that similarity.
NEAR = near_dups.Forest(per_cent=80, estimate=66, trees=32)

#: Scratch folders of earlier stages, which their outputs may still read.
_left: list[str] = []


def _stage(fn: Stage) -> Stage:
    """Removes what earlier stages left behind, once their outputs are written: folders that ``docs`` doesn't read."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        for path in list(_left):
            if not any(path.removeprefix("file:") in name for name in read):
                remove(spark, path)
                _left.remove(path)
        with watched() as made:
            out = fn(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the fertility bands of their language; null and empty texts fail."""
    return quality.keep(docs, "piece_bpe_32k.model")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates; texts without words stay."""
    return near_dups.deduplicate(docs, NEAR)


@_stage
def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; texts without words stay."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the min-cost flow to the sources' targets takes them; a null source is one of its own."""
    return mixing.mix(docs, F.array("source"), word_count(F.col("text")), mixing.Weights())


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place on the Hilbert curve of source, language and size, their shard and their slot."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16
    return hilbert.shard(docs, values=["source", "lang"], sizes=[size], shards=40)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_text), ("mixing", mix_sources), ("sharding", shard),
]

#: The quality rules depend on a tokenizer, which SQL cannot run.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from the table of documents to the shards; only the last stage's table stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        with cleaned(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
