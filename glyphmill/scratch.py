"""Shared scratch space and plan cutting that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


# Folders made inside each open ``cleaned`` block.
_watched: list[list[str]] = []


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glyphmill-"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/glyphmill/{label}-{uuid.uuid4().hex}"
    for made in _watched:
        made.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a shared table and read it back: computed once, lineage cut."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def watched() -> Iterator[list[str]]:
    """The scratch folders made in this block, as a list that grows."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield made
    finally:
        _watched.pop()


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove the scratch folders made in this block; what the given function wrote stays."""
    made: list[str] = []
    _watched.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept = materialize(df, "kept")
        made.pop()
        return kept

    try:
        yield keep
    finally:
        _watched.pop()
        for path in made:
            remove(spark, path)


_shipped: set[str] = set()


def ship_package() -> None:
    """Put this package on the path of the task processes, once per application."""
    sc = SparkContext.getOrCreate()
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).parent
    packed = Path(tempfile.mkdtemp(prefix="glyphmill-")) / f"{here.name}.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, f"{here.name}/{source.relative_to(here)}")
    sc.addPyFile(str(packed))
    _shipped.add(sc.applicationId)
