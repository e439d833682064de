import hashlib

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import manifest

from .conftest import ODD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, ways=3):
    """Rows ``(ident, group, leaf)`` to sorted ``(ident, leaf, subroot, root, [(before, after)])``."""

    def climb(nodes):
        """Root, and the path of each of the nodes."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, spot in enumerate(at):
                run = range(spot // ways * ways, min(len(nodes), spot // ways * ways + ways))
                paths[k].append(("".join(nodes[i] for i in run if i < spot), "".join(nodes[i] for i in run if i > spot)))
            nodes = [sha("".join(nodes[i : i + ways])) for i in range(0, len(nodes), ways)]
            at = [spot // ways for spot in at]
        return nodes[0], paths

    groups = {}
    for ident, group, leaf in rows:
        groups.setdefault(group, []).append((ident is not None, ident or 0, leaf, ident))
    if not groups:
        return []
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = climb([trees[g][0] for g in order])
    return sorted(
        ((x[3], x[2], trees[g][0], root, below + above) for g, above in zip(order, tops) for x, below in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1])), key=str
    )


def shown(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in df.collect()), key=str)


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def rows_of(n):
    """A group that holds most rows, one of one row, one without a name, rows without ids, repeated rows."""
    hot = [(i, f"text {i}", "hot") for i in range(n)]
    return hot + [(1, "only", "é"), (5, "x", None), (None, "y", None), (None, "y", None), (7, None, "hot"), (7, None, "hot"), (9, "", ""), (2, "z" * 100_000, "a")]


@pytest.mark.parametrize(("digits", "n"), [(1, 30), (2, 100), (6, 800), (2, 81), (3, 27)])
def test_paths_equal_a_plain_tree(spark, documents, monkeypatch, digits, n):
    """Blocks of all sizes, over one and several rounds."""
    for name in ("rolled", "proofs"):
        monkeypatch.setattr(getattr(manifest, name), "__defaults__", (digits,))
    monkeypatch.setattr(manifest, "DIGITS", digits)
    rows = rows_of(n)
    docs = documents(rows).withColumns({"leaf": F.lit(1), "path": F.lit(2), "rank": F.lit(3), "group": F.lit(4)})
    made = manifest.manifest(docs, ["doc_id", "text"], "doc_id", "source").cache()
    assert shown(made) == brute([(i, s, leaf((i, t))) for i, t, s in rows])
    checked = made.select((manifest.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in checked)


def test_odd_rows_one_group_and_no_rows(spark, odd, documents):
    made = manifest.manifest(odd, ["doc_id", "source", "text"], "doc_id", "source")
    assert shown(made) == brute([(i, s, leaf((i, s, t))) for i, t, s in ODD])
    one = manifest.manifest(documents([(1, "a", "s")]), ["text"], "doc_id", "source").collect()
    assert [(r.leaf, r.subroot, r.root, r.path) for r in one] == [(sha("1:a"),) * 3 + ([],)]
    assert manifest.manifest(documents([]), ["text"], "doc_id", "source").count() == 0


def test_a_changed_row_does_not_lead_to_the_root(spark, documents):
    docs = documents(rows_of(40))
    made = manifest.manifest(docs, ["text"], "doc_id", "source", {"other": manifest.leaf_of([F.concat(F.coalesce("text", F.lit("")), F.lit("!"))])})
    folds = made.select((manifest.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (manifest.folded(F.col("other"), F.col("path")) == F.col("root")).alias("forged")).collect()
    assert all(r.ok for r in folds) and not any(r.forged for r in folds)


def test_steps_of_a_block_share_one_shuffle(spark, documents):
    nodes = documents(rows_of(10)).select(
        F.col("source").alias("group"), F.col("doc_id").alias("rank"), F.lit(3).alias("height"), F.sha2("text", 256).alias("digest"), F.struct("doc_id").alias("row")
    )
    plan = manifest.rolled(nodes, ["group"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
