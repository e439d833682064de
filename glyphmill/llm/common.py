"""What several operators share: columns, numbering, tables made on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.scratch import materialize, ship_package

#: A run of bytes other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def arrow_stage(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the path of the task processes."""
    ship_package()
    return df.mapInArrow(fn, schema)


def numbered(df: DataFrame, order: list[str | Column], label: str, rank: str = "rank") -> DataFrame:
    """All rows of ``df`` in a global order, written to a scratch table, with a gapless ``rank`` from 0.

    Rows go to range partitions, are sorted and counted there, and get their partition's offset. The
    offsets are one row per partition, so neither the window nor the broadcast grows with the rows.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laid = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": row}), label
    )
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = laid.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return laid.join(F.broadcast(offsets), "_part").withColumn(rank, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")
