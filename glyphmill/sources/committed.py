"""Files that belong together, written together: all files of a unit appear, or none.

Two phases. Tasks stage the files of their units under a folder beside the destination and list them in a manifest; a unit
of which one file cannot be staged is dropped at once. The job's commit names the manifests of the tasks that count, in one
small file; a job that fails before that removes what it staged and nothing has appeared. Then tasks publish by renaming, unit by unit:
folders first, what stood there set aside, and put back if a later file of the unit fails. A publishing task that
is repeated goes on where the first one stopped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from glyphmill.functions import paths
from glyphmill.scratch import materialize, remove, ship_package
from glyphmill.sources.tree import _filesystem

_ROWS = "unit string, dest_path string, content string"
_MANIFEST = "unit string, files array<struct<dest_path:string,staged:string,bytes:long>>, error string"
_REPORT = "unit string, dest_path string, bytes long, error string"
_COMMITTED = "committed.json"


@dataclass
class Staged(WriterCommitMessage):
    """The manifest of one task."""

    manifest: str


class StagedFiles(DataSource):
    """A sink for ``unit, dest_path, content``; ``path`` is the staging folder. Rows of a unit must follow one another in one task."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def schema(self) -> str:
        return _ROWS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StagingWriter(self.options["path"])


class StagingWriter(DataSourceWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, inner = _filesystem(self.staging)
        task = uuid.uuid4().hex
        system.create_dir(f"{inner}/{task}", recursive=True)
        with system.open_output_stream(f"{inner}/{task}.jsonl") as manifest:
            # A row without a unit is one of its own.
            alone = (((r.unit, i if r.unit is None else -1), r) for i, r in enumerate(iterator))
            for n, ((unit, _), rows) in enumerate(groupby(alone, lambda x: x[0])):
                entry = _staged(system, f"{inner}/{task}/{n}", unit, (r for _, r in rows))
                manifest.write((json.dumps(entry) + "\n").encode())
        return Staged(f"{task}.jsonl")

    def commit(self, messages: list[Staged | None]) -> None:
        system, inner = _filesystem(self.staging)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{_COMMITTED}") as f:
            f.write(json.dumps([m.manifest for m in messages if m]).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        system, inner = _filesystem(self.staging)
        system.create_dir(inner, recursive=True)
        system.delete_dir(inner)


def _staged(system, prefix: str, unit: str | None, rows: Iterator[Row]) -> dict:
    """Stages the files of one unit, or none of them."""
    files, error = [], None
    for i, row in enumerate(rows):
        entry = {"dest_path": row.dest_path, "staged": None, "bytes": 0}
        files.append(entry)
        if error or not row.dest_path:
            continue
        try:
            if row.content is None:
                raise ValueError("no content")
            data, at = row.content.encode(), f"{prefix}-{i}"
            with system.open_output_stream(at) as f:
                f.write(data)
            entry.update(staged=at, bytes=len(data))
        except Exception as e:
            error = f"cannot write: {e}"
    if error:
        for entry in files:
            if entry["staged"]:
                system.delete_file(entry["staged"])
            entry.update(staged=None, bytes=0)
    return {"unit": unit, "files": files, "error": error}


def _published(files: list[dict]) -> str | None:
    """Moves the staged files of one unit to their places; on failure everything is as before, and the reason is returned."""
    from pyarrow import fs

    undo: list[tuple] = []
    try:
        places = [(f["staged"], *_filesystem(f["dest_path"])) for f in files if f["staged"]]
        for _, system, inner in places:
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        for staged, system, inner in places:
            kind = lambda path: system.get_file_info(path).type  # noqa: B023, E731
            old = staged + ".old"
            if kind(inner) == fs.FileType.Directory:
                raise IsADirectoryError(inner)
            if kind(staged) == fs.FileType.NotFound:  # an earlier attempt has moved it
                undo.append((system, inner, staged, old))
                continue
            if kind(inner) == fs.FileType.File and kind(old) == fs.FileType.NotFound:
                system.move(inner, old)
            undo.append((system, inner, staged, old))
            system.move(staged, inner)
    except Exception as e:
        for system, inner, staged, old in reversed(undo):
            if system.get_file_info(staged).type == fs.FileType.NotFound:
                system.move(inner, staged)
            if system.get_file_info(old).type == fs.FileType.File:
                system.move(old, inner)
        return f"cannot write: {e}"
    return None


def _publishing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for unit, files, error in zip(pdf["unit"], pdf["files"], pdf["error"]):
            error = error or _published(files)
            out += [(unit, f["dest_path"], 0 if error else f["bytes"], error) for f in files]
        yield pd.DataFrame(out, columns=["unit", "dest_path", "bytes", "error"])


def stage(outputs: DataFrame, staging: str) -> None:
    """The first phase: ``unit, dest_path, content`` under ``staging``, committed as a whole or removed."""
    spark = outputs.sparkSession
    ship_package()
    spark.dataSource.register(StagedFiles)
    # Units without a name are dealt by their place.
    keys = ["unit", F.when(F.col("unit").isNull(), F.col("dest_path"))]
    rows = outputs.select("unit", "dest_path", "content").repartition(*keys).sortWithinPartitions("unit")
    rows.write.format(StagedFiles.name()).mode("append").save(staging)


def publish(spark: SparkSession, staging: str) -> DataFrame:
    """The second phase: ``unit, dest_path, bytes, error`` for every file of a committed staging folder. May be repeated."""
    system, inner = _filesystem(staging)
    with system.open_input_stream(f"{inner}/{_COMMITTED}") as f:
        manifests = [f"{staging}/{name}" for name in json.loads(f.read())]  # one for each task
    if not manifests:
        return spark.createDataFrame([], _REPORT)
    listed = spark.read.schema(_MANIFEST).json(manifests)
    return materialize(listed.mapInPandas(_publishing, _REPORT), "published")


def write_together(outputs: DataFrame, root: str) -> DataFrame:
    """Write ``content`` to ``dest_path``, all files of a ``unit`` or none; returns ``unit, dest_path, bytes, error`` for every row.

    ``root`` is a folder on the file system of the destinations, in which files are staged. Existing files are replaced. An empty or null path writes
    nothing, null content fails its unit, a row without a unit stands alone, and no rows give an empty report. A unit's files go to one task.
    """
    staging = f"{paths.clean_root(root)}/.staging-{uuid.uuid4().hex}"
    stage(outputs, staging)
    report = publish(outputs.sparkSession, staging)
    remove(outputs.sparkSession, staging)
    return report
