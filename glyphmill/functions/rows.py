"""Helpers for expressions that are costly to evaluate twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Tasks for each core that ``spread`` makes of a scan.
TASKS_PER_CORE = 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def take(array: Column, start: Column, n: Column) -> Column:
    """``n`` elements from index ``start``, in time that depends on ``n`` alone.

    ``slice`` copies the whole array first, which adds up when many ranges are cut from one.
    """
    picked = F.transform(F.sequence(start, start + n - 1), lambda i: F.get(array, i))
    return F.when(n > 0, picked).otherwise(F.slice(F.array(F.get(array, F.lit(0))), 1, 0))


def fold(
    array: Column, zero: Column, fields: list[str], step: Callable[[Column, Column, Column], Column], chunk: int = 512
) -> Column:
    """``aggregate`` for a state struct of ``fields`` plus an array ``out`` that grows.

    ``step`` takes the state, an element and its index. Each step of an aggregate copies
    its state, and with it all that is in ``out``. Folding chunk by chunk, with the results
    of a chunk kept apart until its end, keeps that linear for any realistic length.
    """

    def whole(state: Column, part: Column) -> Column:
        start = F.struct(*[state[f].alias(f) for f in fields], zero["out"].alias("out"))
        return let(
            F.aggregate(part, start, lambda s, x: step(s, x["item"], x["at"])),
            lambda r: F.struct(*[r[f].alias(f) for f in fields], F.concat(state["out"], r["out"]).alias("out")),
        )

    def chunked(items: Column) -> Column:
        last = F.size(items) - 1
        item = lambda i: F.struct(F.get(items, i).alias("item"), i.alias("at"))
        chunks = F.transform(
            F.sequence(F.lit(0), last, F.lit(chunk)),
            lambda c: F.transform(F.sequence(c, F.least(c + chunk - 1, last)), item),
        )
        return F.when(last >= 0, chunks).otherwise(F.slice(F.array(F.array(item(F.lit(0)))), 1, 0))

    return F.aggregate(let(array, chunked), zero, whole)


def explode_indexed(df: DataFrame, keep: list[str], array: Column | str, index: str, value: str) -> DataFrame:
    """One row per element of a computed array, with its index.

    The outer form: for the inner one the optimizer adds a filter on the array's size,
    which below the projections means computing the whole array a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(index, value)).filter(F.col(index).isNotNull())


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan with fewer than ``TASKS_PER_CORE`` partitions for each core; otherwise leave it.

    For work that costs far more than moving the rows. With few splits, some of which may hold no group
    of rows, cores would wait for the last ones. A large input has more splits, and then nothing is shuffled. Only
    for frames straight from a scan.
    """
    tasks = TASKS_PER_CORE * scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(tasks, *keys) if scan.rdd.getNumPartitions() < tasks else scan
