"""Source trees: listing every file, and reading the routed ones."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import paths
from glyphmill.scratch import scratch_dir, ship_package

# ``error``: why a folder could not be listed; such a row is neither a file nor a folder to walk.
_LISTED = "path string, is_dir boolean, length long, error string"
log = logging.getLogger(__name__)

_BATCH_BYTES = 16 << 20
_BATCH_ROWS = 2048


def _filesystem(location: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    if location.startswith("file:"):
        return fs.LocalFileSystem(), "/" + location.removeprefix("file:").lstrip("/")
    if "://" in location:
        return fs.FileSystem.from_uri(location.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), location


def _entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    system, inner = _filesystem(folder)
    if system.type_name == "local":
        with os.scandir(inner) as found:
            for e in found:
                if e.is_dir():
                    if not e.is_symlink():  # linked folders are not walked
                        yield f"{folder}/{e.name}", True, 0
                elif os.path.exists(e.path):
                    yield f"{folder}/{e.name}", False, e.stat().st_size
        return
    from pyarrow import fs

    for info in system.get_file_info(fs.FileSelector(inner)):
        is_dir = info.type == fs.FileType.Directory
        yield f"{folder}/{info.base_name}", is_dir, 0 if is_dir else info.size


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame(rows):
        out = pd.DataFrame(rows, columns=["path", "is_dir", "length", "error"])
        return out.astype({"is_dir": "boolean", "length": "Int64"})

    for pdf in batches:
        for folder in pdf["path"]:
            rows, found = [], _entries(folder)
            while True:
                try:
                    row = next(found, None)
                except OSError as e:
                    row = None
                    rows.append((folder, None, None, f"cannot list: {e}"))
                if row is not None:
                    rows.append((*row, None))
                if rows and (row is None or len(rows) >= _BATCH_ROWS):
                    yield frame(rows)
                    rows = []
                if row is None:
                    break


def list_tree(spark: SparkSession, root: str, *, ignored: list[str] | None = None, folders_per_task: int = 32) -> DataFrame:
    """Every file at any depth: ``path, rel_path, length``, hidden and empty ones included.

    ``ignored`` locations are left out as ``paths.ignored`` defines them, and a folder that lies in one is never opened: the filter
    stands between the levels.

    Links that lead nowhere are left out. A folder that cannot be listed, or is gone by then, is
    logged with its error and has no files; the others are listed all the same.

    Spark's file sources drop both, so the tree is walked here, one level per job: the
    folders of a level are listed in parallel and written to a shared table, which is
    also where the next level's folders come from. The driver sees one count per level.
    """
    ship_package()
    root = paths.clean_root(root)
    out = scratch_dir(spark, "listing")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, count, depth = spark.createDataFrame([(root,)], "path string"), 1, 0
    while count:
        spread = folders.repartition(max(1, min(width, -(-count // folders_per_task))), "path")
        spread.mapInPandas(_list_folders, _LISTED).write.parquet(f"{out}/depth={depth}")
        level = spark.read.schema(_LISTED).parquet(f"{out}/depth={depth}")
        folders = level.filter("is_dir").select("path")
        if ignored:  # what is below such a folder begins with its path, too
            folders = folders.filter(~paths.ignored(F.col("path"), root, ignored))
        count, depth = folders.count(), depth + 1
    listed = spark.read.schema(_LISTED).parquet(*[f"{out}/depth={d}" for d in range(depth)])
    for row in listed.filter("error is not null").limit(20).collect():  # a report; the rows are in the listing
        log.warning("'%s': %s", row["path"], row["error"])
    files = listed.filter("not is_dir")
    if ignored:
        files = files.filter(~paths.ignored(paths.directory(F.col("path")), root, ignored))
    return files.select("path", paths.relative(F.col("path"), root).alias("rel_path"), "length")


def top_level_names(spark: SparkSession, root: str) -> DataFrame:
    """Names directly under the root, files and folders."""
    ship_package()
    roots = spark.createDataFrame([(paths.clean_root(root),)], "path string")
    return roots.mapInPandas(_list_folders, _LISTED).filter("error is null").select(paths.file_name(F.col("path")).alias("name"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame(rows, columns):
        return pd.DataFrame(rows, columns=[*columns, "content", "error"])

    for pdf in batches:
        rows, size = [], 0
        for row in pdf.itertuples(index=False):
            try:
                system, inner = _filesystem(row.path)
                with system.open_input_stream(inner) as f:
                    content, error = f.read(), None
            except Exception as e:
                content, error = None, f"cannot read: {e}"
            rows.append((*row, content, error))
            size += len(content or b"")
            if size >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                yield frame(rows, pdf.columns)
                rows, size = [], 0
        if rows:
            yield frame(rows, pdf.columns)


def read_contents(files: DataFrame, *, task_bytes: int = 128 << 20) -> DataFrame:
    """Add ``content`` (binary) and ``error`` for each listed file.

    Only the files given are opened, so filter and route on names first. They are spread
    by hash into tasks of about ``task_bytes``, and no content is shuffled.
    """
    ship_package()
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition(int(n), "path").mapInPandas(_read, schema + ", content binary, error string")
