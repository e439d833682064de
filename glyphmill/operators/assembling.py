"""From replies back to one text per file, and to the outcome report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.packing import SEPARATOR
from glyphmill.operators.segmenting import CLASS_ONLY, FULL, METHODS_ONLY

# Fixed value: where a skeleton reply wants its methods.
METHODS_MARK = "${METHODS}"


def concat_in_order(rows: Column, order: str, text: str) -> Column:
    """``SEPARATOR + text`` of each collected row, by ``order``, as one string.

    ``rows`` is an array of structs whose first field is ``order``.
    """
    return F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(F.lit(SEPARATOR), r[text])), "")


def splice_methods(skeleton: Column, methods: Column) -> Column:
    """Methods in place of every mark, or after the skeleton if it has none."""
    return F.when(F.contains(skeleton, F.lit(METHODS_MARK)), F.replace(skeleton, F.lit(METHODS_MARK), methods)).otherwise(
        F.concat(skeleton, methods)
    )


def gather_replies(replies: DataFrame, parts: list[str], keys: list[str]) -> DataFrame:
    """One row per file from its replies: for each part ``p``, ``p_full``, ``p_class`` and ``p_methods``.

    ``error`` is that of the file's first failing piece; one failing piece fails the whole file.
    The group is one file, whose output is a single string value anyway.
    """
    ix, kind = F.col("piece_ix"), F.col("kind")
    aggs = [
        F.min(F.when(F.col("error").isNotNull(), F.struct(ix.alias("ix"), F.col("error").alias("error")))).alias("_bad"),
        F.max(F.when(kind == FULL, True)).alias("_is_full"),
    ]
    for p in parts:
        aggs += [
            F.max(F.when(kind == FULL, F.col(p))).alias(f"{p}_full"),
            F.max(F.when(kind == CLASS_ONLY, F.col(p))).alias(f"{p}_class"),
            F.collect_list(F.when(kind == METHODS_ONLY, F.struct(ix.alias("ix"), F.col(p).alias("text")))).alias(f"_{p}"),
        ]
    grouped = replies.groupBy(*keys).agg(*aggs).withColumn("error", F.col("_bad.error"))
    for p in parts:
        grouped = grouped.withColumn(f"{p}_methods", concat_in_order(F.col(f"_{p}"), "ix", "text"))
    return grouped.drop("_bad", *[f"_{p}" for p in parts])


def outcome_report(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """How many units of work ended in each status."""
    return outcomes.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))
