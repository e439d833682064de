"""Known pairs: reading them, numbering them in input order, upserting by id."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.scratch import materialize

log = logging.getLogger(__name__)

PAIR = "source string, target string"
INDEXED = f"pair_ix long, {PAIR}"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``source, target`` from YAML (root key ``translations``), JSON lines or Parquet."""
    return read_indexed_pairs(spark, path).select("source", "target")


def read_indexed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``pair_ix, source, target``: the place of a pair in a YAML file, or that column of a table, null if it has none.

    A missing file or root key is a warning and gives no pairs. YAML is for the small
    hand-written lists; large tables come as Parquet or JSON.
    """
    if path.endswith((".yaml", ".yml")):
        return _read_yaml(spark, path)
    reader = spark.read.schema(INDEXED)
    try:
        return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log.warning("no known pairs found at '%s'", path)
        return spark.createDataFrame([], INDEXED)


def _read_yaml(spark: SparkSession, path: str) -> DataFrame:
    import yaml

    if not os.path.isfile(path):
        log.warning("no known pairs found at '%s'", path)
        return spark.createDataFrame([], INDEXED)
    with open(path, encoding="utf-8") as f:
        content = yaml.safe_load(f) or {}
    if "translations" not in content:
        log.warning("'%s' has no root key 'translations'", path)
        return spark.createDataFrame([], INDEXED)
    return spark.createDataFrame([(i, p["source"], p["target"]) for i, p in enumerate(content["translations"])], INDEXED)


def number_in_order(df: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Add ``out``: 1, 2, ... by ``order``, without gathering the rows in one task.

    Rows are range-partitioned and sorted, and written once so that every row keeps its
    partition; the position is the place in the partition plus the sizes of those before,
    a table with one row per partition.
    """
    placed = (
        df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # The id holds the partition in its upper bits and the row's place in the lower 33.
    placed = materialize(placed, "ordered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")  # one row per partition
        .withColumn(out, F.col("_before") + place + 1)
        .drop("_part", "_before", "_at")
    )


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace existing ones with the same key; the rest stay.

    One aggregate that combines before the shuffle, so a key with many versions is cheap.
    """
    cols = [c for c in existing.columns if c != key]
    both = existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    latest = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("_v")).alias("_row"))
    return latest.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols])
