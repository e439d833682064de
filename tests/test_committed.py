import os

import pytest
from pyspark.sql import functions as F

from glyphmill.scratch import watched
from glyphmill.sources import committed, tree

ROWS = "unit string, dest_path string, content string"


def names(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files if not f.endswith(".crc")}


def test_both_files_or_neither(spark, tmp_path):
    """The implementation fails: in staging (no content), at its folder (a file stands there), or at its place (a folder stands there)."""
    root = str(tmp_path)
    (tmp_path / "blocked").write_text("a file")
    os.makedirs(tmp_path / "taken.cpp")
    (tmp_path / "taken.h").write_text("old header")
    rows = [
        ("ok", f"{root}/x/ok.h", "header"), ("ok", f"{root}/x/ok.cpp", "é"),
        ("null", f"{root}/null.h", "header"), ("null", f"{root}/null.cpp", None),
        ("blocked", f"{root}/b.h", "header"), ("blocked", f"{root}/blocked/b.cpp", "body"),
        ("taken", f"{root}/taken.h", "new header"), ("taken", f"{root}/taken.cpp", "body"),
        (None, f"{root}/one", "1"), (None, f"{root}/two", None), (None, "", "nowhere"),
    ]
    report = {(r["unit"], r["dest_path"]): r for r in committed.write_together(spark.createDataFrame(rows, ROWS), root).collect()}
    assert len(report) == len(rows)
    assert {u for (u, _), r in report.items() if r["error"]} == {"null", "blocked", "taken", None}
    assert report["ok", f"{root}/x/ok.cpp"]["bytes"] == 2 and report[None, f"{root}/one"]["error"] is None
    assert names(root) == {"blocked", "taken.h", "x/ok.h", "x/ok.cpp", "one"}
    assert (tmp_path / "taken.h").read_text() == "old header"


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"{tmp_path}/a.h", "x"), ("b", f"{tmp_path}/b.h", "y")], ROWS)
    broken = rows.withColumn("content", F.when(F.col("unit") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        committed.write_together(broken, str(tmp_path))
    assert names(tmp_path) == set()


def test_publishing_goes_on_where_it_stopped(spark, tmp_path):
    root, staging = str(tmp_path), f"{tmp_path}/staging"
    rows = [("a", f"{root}/a.h", "new"), ("a", f"{root}/a.cpp", "new")]
    (tmp_path / "a.h").write_text("old")
    committed.stage(spark.createDataFrame(rows, ROWS), staging)
    assert (tmp_path / "a.h").read_text() == "old" and not (tmp_path / "a.cpp").exists()
    for _ in range(2):
        assert [r["error"] for r in committed.publish(spark, staging).collect()] == [None, None]
        assert (tmp_path / "a.h").read_text() == (tmp_path / "a.cpp").read_text() == "new"


def test_no_rows(spark, tmp_path):
    assert committed.write_together(spark.createDataFrame([], ROWS), str(tmp_path)).count() == 0
    assert names(tmp_path) == set()


def test_ignored_folders_are_not_opened(spark, tmp_path):
    for name in ("Library/a/deep.cs", "LibraryX/b.cs", "Assets/Library/c.cs", "Packages/d.cs", "Packages/in/e.cs", "top.cs"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text("x")
    with watched() as made:
        kept = tree.list_tree(spark, str(tmp_path), ignored=["Library", "Packages/"])
    assert {r["rel_path"] for r in kept.collect()} == {"Assets/Library/c.cs", "Packages/d.cs", "top.cs"}
    listed = {r["path"] for r in spark.read.parquet(f"{made[0]}/depth=*").select("path").collect()}
    assert not [p for p in listed if p.startswith((f"{tmp_path}/Library/", f"{tmp_path}/LibraryX/", f"{tmp_path}/Packages/in/"))]
