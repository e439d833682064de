"""A Merkle manifest of a dataset: one root digest, and for each row the proof that it belongs to it.

Rows become leaves, the leaves of a group (a source) are a tree of ``WAYS`` ways in order of their ids, and the groups' roots are
one more tree. A leaf's rank is written in digits of base ``WAYS``; a *block* is what shares all but the last ``DIGITS`` digits. Within
a block the digit columns are grouped away one after the other, from the last: each step nests the structs of the step before as
children of the next, so one shuffle by block serves all steps, and a block ends as one nested struct of bounded size that holds its
whole subtree. Blocks are the leaves of the next round, until one node remains.
Proofs go down the same structs: a transform a level hands every child the digests of its siblings, and an explode emits leaves
with their whole paths. Only a block's own path comes from the round above, one row for each block.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.scratch import materialize

#: Children of a node.
WAYS = 3
#: Levels of a block: 729 leaves, some 150 KB.
DIGITS = 6
#: Powers of ``WAYS`` up to the largest rank that a long holds.
_POWERS = [WAYS**i for i in range(40) if WAYS**i < 1 << 63]

_STEP = "struct<before:string,after:string>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row: hex SHA-256 of its encoded values."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def height_of(n: Column) -> Column:
    """Levels above ``n`` leaves: the least h with ``WAYS`` to the h not under ``n``."""
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in _POWERS]), lambda p: p < n))


def ranked(leaves: DataFrame, group: list[str], order: list[str | Column], label: str) -> DataFrame:
    """``leaves`` with ``rank`` from 0 in their group and ``height`` of the group's tree, written in a global order.

    Rows go to range partitions by group and order, so a group that holds most rows has many tasks. What a partition holds of a group is
    counted, and running sums of these counts, one row for each partition and group in it, give where its ranks begin.
    """
    first = [F.col(c).asc_nulls_first() for c in group]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    laid = materialize(
        leaves.repartitionByRange(*first, *order).sortWithinPartitions(*first, *order).withColumns({"_part": F.spark_partition_id(), "_row": row}), label
    )
    parts = laid.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_row").alias("_from"))
    of_group = W.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(
        F.col("_part").alias("_at"), *[F.col(c).alias(f"_of_{i}") for i, c in enumerate(group)], (before - F.col("_from")).alias("_start"), height_of(F.sum("_n").over(of_group)).alias("height")
    )
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    joined = laid.join(starts, same).withColumn("rank", F.col("_start") + F.col("_row"))
    return joined.drop("_part", "_row", "_at", "_start", *[f"_of_{i}" for i in range(len(group))])


def _digest(kids: Column, hashed: Column) -> Column:
    """The digest of a run of children; a level above the root passes its only child on."""
    joined = F.array_join(F.transform(kids, lambda k: k["digest"]), "")
    return F.when(hashed, F.sha2(joined, 256)).otherwise(F.get(kids, F.lit(0))["digest"])


def rolled(nodes: DataFrame, group: list[str], digits: int = DIGITS) -> DataFrame:
    """Blocks of ``nodes`` (``group, rank, height, digest`` and a struct ``row``): ``group, rank, height, digest, tree``.

    ``tree`` nests ``digits`` levels of ``digit, digest, kids``; the innermost children hold ``row``. ``rank`` counts blocks, ``height``
    the levels that are left above them.
    """
    block = F.expr(f"rank div {WAYS ** digits}L")
    places = [F.expr(f"int((rank div {WAYS ** i}L) % {WAYS})").alias(f"_d{i}") for i in range(digits)]
    level = nodes.select(*group, block.alias("_block"), "height", *places, "digest", "row").repartition(*group, "_block")
    inner = ["digest", "row"]
    for i in range(digits):
        keys = [*group, "_block", "height", *[f"_d{j}" for j in range(i + 1, digits)]]
        kids = level.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(f"_d{i}").alias("digit"), *inner))).alias("kids"))
        level = kids.select(*keys, _digest(F.col("kids"), F.col("height") > i).alias("digest"), "kids")
        inner = ["digest", "kids"]
    return level.select(*group, F.col("_block").alias("rank"), F.greatest(F.col("height") - digits, F.lit(0)).alias("height"), "digest", F.struct("kids", F.col("height")).alias("tree"))


def _steps_down(kids: Column, path: Column, hashed: Column) -> Column:
    """Children with the path of each: the digests of its siblings, to the left and right, before the path of their parent."""

    def step(kid: Column, i: Column) -> Column:
        side = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda k: k["digest"]), "")
        here = F.struct(side(lambda k: k["digit"] < kid["digit"]).alias("before"), side(lambda k: k["digit"] > kid["digit"]).alias("after"))
        return F.struct(kid.alias("node"), F.when(hashed, F.concat(F.array(here), path)).otherwise(path).alias("path"))

    return F.transform(kids, step)


def _down(hashed: Column) -> Callable[[Column], Column]:
    return lambda item: _steps_down(item["node"]["kids"], item["path"], hashed)


def proofs(blocks: DataFrame, group: list[str], digits: int = DIGITS) -> DataFrame:
    """``group, rank, row, digest, path`` for what the blocks hold, from their ``tree`` and their own ``path``: no join, no shuffle."""
    items = _steps_down(F.col("tree.kids"), F.col("path"), F.col("tree.height") >= digits)
    for i in range(digits - 1, 0, -1):
        items = F.flatten(F.transform(items, _down(F.col("tree.height") >= i)))
    out = blocks.select(*group, F.explode_outer(items).alias("_it")).filter("_it is not null")
    return out.select(*group, "_it.node.row", "_it.node.digest", "_it.path")


def _tree(nodes: DataFrame, group: list[str], label: str) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of blocks, from the leaves up, and ``group, digest`` of the roots."""
    # The number of rounds follows from the highest tree; it is one number.
    highest = nodes.agg(F.max("height")).first()[0] or 0
    rounds = []
    while True:
        blocks = materialize(rolled(nodes, group), label)
        rounds.append(blocks)
        if highest <= DIGITS:
            return rounds, blocks.select(*group, "digest")
        highest -= DIGITS
        nodes = blocks.select(*group, "rank", "height", "digest", F.struct(F.col("rank").alias("rank")).alias("row"))


def _paths(rounds: list[DataFrame], group: list[str], roots: DataFrame) -> DataFrame:
    """The leaves under ``roots`` (``group, path``) with the paths up to them."""
    path = roots.withColumn("rank", F.lit(0).cast("long"))
    for i, blocks in enumerate(reversed(rounds)):
        joined = path.select(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate(group)], F.col("rank").alias("_block"), *[c for c in path.columns if c not in (*group, "rank")])
        same = F.col("rank") == F.col("_block")
        for k, c in enumerate(group):
            same &= F.col(c).eqNullSafe(F.col(f"_of_{k}"))
        extra = [c for c in roots.columns if c not in (*group, "path")]
        held = blocks.join(joined, same).select(*group, *extra, "tree", "path")
        down = proofs(held, [*group, *extra])
        if i < len(rounds) - 1:
            path = down.select(*group, *extra, "path", F.col("row.rank").alias("rank"))
        else:
            return down
    raise AssertionError("a tree has a round")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along its path."""
    return F.aggregate(path, digest, lambda at, step: F.sha2(F.concat(step["before"], at, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level from the leaf, left to right, in one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, columns: list[str], ident: str, group: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``ident``, the columns of ``extra``, ``leaf``, ``subroot``, ``root`` and ``path``.

    ``leaf`` is the digest of ``columns``; ``path`` lists, level by level from the leaf to the root, the digests of the siblings before
    and after, joined to a string each. Leaves of a group are in order of ``ident``, nulls first, ties by digest; groups in order of
    their UTF-8 bytes, null first. Null values, empty and very long texts are encoded like others; repeated rows are leaves of their
    own; an empty table gives none. Other columns of ``docs`` are not read, whatever their names; an ``extra`` column may have any name but those of the result.
    """
    more = extra or {}
    row = F.struct(F.col(ident).alias("ident"), *[c.alias(f"x{i}") for i, c in enumerate(more.values())])
    leaves = docs.select(F.col(group).cast("string").alias("group"), F.col(ident).alias("ident"), leaf_of([F.col(c) for c in columns]).alias("digest"), row.alias("row"))
    nodes = ranked(leaves, ["group"], [F.col("ident").asc_nulls_first(), F.col("digest")], "manifest-leaves").drop("ident")
    rounds, subroots = _tree(nodes, ["group"], "manifest-blocks")
    # The groups are the leaves of the tree above, all in one group.
    tops = ranked(subroots.select(F.lit(0).alias("all"), "group", "digest"), ["all"], [F.col("group").asc_nulls_first()], "manifest-subroots")
    upper, root = _tree(tops.select("all", "rank", "height", "digest", F.struct("group", F.col("digest").alias("subroot")).alias("row")), ["all"], "manifest-groups")
    above = _paths(upper, ["all"], root.select("all", F.col("digest").alias("root"), F.array().cast(f"array<{_STEP}>").alias("path")))
    of_groups = materialize(above.select("row.group", "row.subroot", "root", "path"), "manifest-paths")
    down = _paths(rounds, ["group"], of_groups)
    return down.select(
        F.col("row.ident").alias(ident), *[F.col(f"row.x{i}").alias(name) for i, name in enumerate(more)], F.col("digest").alias("leaf"), "subroot", "root", "path"
    )
