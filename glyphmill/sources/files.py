"""Writing one file per row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from glyphmill.scratch import ship_package
from glyphmill.sources.tree import _filesystem


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    made: set[str] = set()
    for pdf in batches:
        done = []
        for path, content in zip(pdf["dest_path"], pdf["content"]):
            size, error = 0, None
            try:
                if path:
                    data = content.encode("utf-8")
                    system, inner = _filesystem(path)
                    folder = inner.rsplit("/", 1)[0]
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    # Where a rename is atomic, a reader never sees half a file, even if the
                    # task is retried or runs twice; object stores publish on close.
                    staged = system.type_name in ("local", "hdfs")
                    target = f"{folder}/.{uuid.uuid4().hex}.part" if staged else inner
                    with system.open_output_stream(target) as f:
                        f.write(data)
                    if staged:
                        system.move(target, inner)
                    size = len(data)
            except Exception as e:
                error = f"cannot write: {e}"
            done.append((path, size, error))
        yield pd.DataFrame(done, columns=["dest_path", "bytes", "error"])


def write_files(outputs: DataFrame) -> DataFrame:
    """Write ``content`` to ``dest_path`` row by row, overwriting; an empty path writes nothing.

    Lazy: the files appear when the returned ``dest_path, bytes, error`` are computed.
    """
    ship_package()
    return outputs.select("dest_path", "content").mapInPandas(_write, "dest_path string, bytes long, error string")
