"""Which files are taken, by whom, and where their output goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import paths


def missing_names(found: DataFrame, required: list[str], name: str = "name") -> DataFrame:
    """The required names that do not occur in ``found``."""
    wanted = found.sparkSession.createDataFrame([(r,) for r in required], f"{name} string")
    return wanted.join(found.select(name), name, "left_anti")


def ignore_locations(files: DataFrame, root: str, ignored: list[str] | None, path: str = "path") -> DataFrame:
    """Drop files whose directory string starts with an ignored location.

    A raw prefix, as the directory text is compared: ``Library`` also drops ``LibraryX``.
    """
    if not ignored:
        return files
    return files.filter(~paths.ignored(paths.directory(F.col(path)), root, ignored))


def route_by_extension(files: DataFrame, strategies: dict[str, str | None], path: str = "path") -> DataFrame:
    """Add ``strategy`` by case-sensitive extension; files without one are passed over.

    The routes are settings, so they enter the plan as literals and the filter stays narrow.
    """
    route = F.lit(None).cast("string")
    ext = paths.extension(F.col(path))
    for key, strategy in strategies.items():
        if strategy:
            route = F.when(ext == key, F.lit(strategy)).otherwise(route)
    return files.withColumn("strategy", route).filter(F.col("strategy").isNotNull())


def mark_collisions(files: DataFrame, path: str = "path", dest: str = "dest_path") -> DataFrame:
    """Add ``wins``: true for the smallest source path among those with the same destination.

    Needs no content, so it runs on names before any file is read. The minimum is
    combined before the shuffle, and the join is on the pair, so one crowded
    destination does not gather in a task. Names pack well, so a table of very many may look
    small enough to be sent through the driver; the hint keeps it from that.
    """
    firsts = files.groupBy(dest).agg(F.min(path).alias(path)).select(path, dest, F.lit(True).alias("_first"))
    joined = files.join(firsts.hint("merge"), [path, dest], "left")
    return joined.withColumn("wins", F.coalesce("_first", F.lit(False))).drop("_first")
