"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.scratch import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``; the component is its smallest node.

    A round moves every link towards the smallest neighbour that its ends have; rounds grow with the logarithm of the
    longest path. All steps are minima that combine before the shuffle and joins on them, so a node with very many
    links is split like any skewed join. A round's links are written and read again: nothing is collected.
    """
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while True:
        # Large star: the greater neighbours of a node go to the smallest of its neighbours and itself.
        ends = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = ends.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = materialize(small.union(least.select("a", F.col("least").alias("b"))).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
