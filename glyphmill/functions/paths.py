"""Path arithmetic on ``/``-separated path columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import camel_to_snake, snake_to_camel

# Stem and extension of a file name; leading dots belong to the stem.
_NAME = r"^(\.*[^.].*)(\.[^.]*)$"


def clean_root(root: str) -> str:
    return root.rstrip("/") or "/"


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "(?s)([^/]*)$", 1)


def stem(name: Column) -> Column:
    return F.when(name.rlike("(?s)" + _NAME), F.regexp_extract(name, "(?s)" + _NAME, 1)).otherwise(name)


def extension(path: Column) -> Column:
    """Last dot and what follows, empty if none; case is kept."""
    return F.regexp_extract(file_name(path), "(?s)" + _NAME, 2)


def relative(path: Column, root: str) -> Column:
    root = clean_root(root)
    skip = 1 if root == "/" else len(root) + 1
    return F.substr(path, F.lit(skip + 1))


def ignored(folder: Column, root: str, names: list[str]) -> Column:
    """Whether a folder's path starts with an ignored location, as raw text: ``Library`` also stands for ``LibraryX``."""
    prefix = "/" if clean_root(root) == "/" else clean_root(root) + "/"
    return reduce(lambda a, b: a | b, [folder.startswith(prefix + name) for name in names])


def destination_path(
    path: Column,
    source_root: str,
    destination_root: str,
    new_extension: str,
    *,
    lower_folders: bool = False,
    camel_case: bool = False,
    snake_case: bool = False,
) -> Column:
    """Where the output of ``path`` goes; camelCase wins over snake_case."""
    rel = relative(path, source_root)
    folder = directory(rel)
    if lower_folders:
        folder = F.lower(folder)
    name = stem(file_name(rel))
    if camel_case:
        name = snake_to_camel(name)
    elif snake_case:
        name = camel_to_snake(name)
    leaf = F.concat(name, F.lit(new_extension))
    return F.concat_ws("/", F.lit(clean_root(destination_root)), F.when(folder != "", folder), leaf)
