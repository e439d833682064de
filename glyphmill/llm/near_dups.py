"""Near-duplicates by an LSH forest, confirmed on full shingle sets.

1. Every text becomes the set of its distinct five-word shingles. Rows are numbered in
   a written table, so ids may be null or repeated; equal sets are one *class*, represented by its first row.
2. A class has a row in each of several sorted orders (trees): its whole signature, turned so that every order begins with
   other min-hashes. Rows are sorted by range, so a crowded stretch of an order spreads over many tasks.
3. The longest common prefix of neighbours says how far back a row looks: as long as rows share ``LEAST`` values with
   it, the nearest ``Forest.crowd`` of them at most. In a crowded stretch that is the same as a greater depth, up to the whole
   signature, so no task compares all pairs of a stretch. Candidates whose whole signatures are similar enough span a
   *region*. A region is wider than a group of near-duplicates: what a row did not look at is found there.
4. In a region, all sets are compared exactly, through an index of shingles that is local to the region, and the links
   that join what is not joined yet are kept. Large regions are cut into blocks, and pairs of blocks are compared
   in different tasks. No pair is ever written that is not needed to connect two groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_stage, numbered, text_bytes
from glyphmill.llm.components import connected
from glyphmill.scratch import materialize

#: Words of a shingle.
SHINGLE = 5
#: Min-hashes from the start of one order to the start of the next, and the fewest at its start that candidates share.
STRIDE, LEAST = 6, 4
#: Rows of an order that one task compares at a time, beside those before them that they look back at, in multiples of ``crowd``.
_CHUNK = 4
_LINKS = "a long, b long"


@dataclass(frozen=True)
class Forest:
    """``per_cent``: similarity that links. A pair at 85 % shares four values in one of 24 trees but for 2 in 100 million cases.

    Each row looks back at ``crowd`` rows in each order. Where more rows share four values, a pair must share
    about as many as set it apart from all but ``crowd``, or be connected by others: with nine values 2 in 1,000 pairs at 85 % are missed that
    nothing else connects. ``estimate`` of equal min-hashes, in per cent, makes a pair a candidate: more
    than four standard errors below the threshold. ``block`` bounds what one task compares of a region and changes no result.
    """

    per_cent: int = 85
    trees: int = 24
    estimate: int = 72
    crowd: int = 1024
    block: int = 2048
    block_shingles: int = 4_000_000


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, none has none."""
    words = text.lower().split()
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n == 0:
        return hashes
    last = max(1, n - SHINGLE + 1)
    out = np.full(last, min(n, SHINGLE), np.uint64)
    for i in range(min(n, SHINGLE)):
        out += hashes[i : last + i]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(6)
    return rng.integers(0, 1 << 32, (n, 1), np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (n, 1), np.uint32)


def signature(found: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A 16-bit digest of each min-hash."""
    short = (found >> np.uint64(32)).astype(np.uint32)
    step = max(1, 4_000_000 // max(1, len(short)))
    least = np.concatenate([(((short ^ masks[i : i + step]) * factors[i : i + step])).min(axis=1) for i in range(0, len(factors), step)])
    return ((least * np.uint32(0x85EBCA6B) ^ (least >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(16)).astype("<u2")


def _signing(trees: int):
    factors, masks = _seeds(trees * STRIDE)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, signatures = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                counts.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                signatures.append(signature(found, factors, masks).tobytes() if len(found) else b"")
            new = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.record_batch([batch.column(0), batch.column(1), *new], ["node", "doc_id", "n_shingles", "digest", "signature"])

    return sign


class _Joined:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others:
            a, b = self.find(i), self.find(int(j))
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def links(self, nodes: np.ndarray) -> Iterator[tuple[int, int]]:
        """A star for each group of more than one row."""
        for i in range(len(nodes)):
            r = self.find(i)
            if r != i:
                yield int(nodes[i]), int(nodes[r])


def _pairs(batches: Iterator[pa.RecordBatch], keys: list[str], compare) -> Iterator[pa.RecordBatch]:
    """Runs ``compare`` on the rows of each key; rows come sorted by key, and one key's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    current = None

    def flush() -> pa.RecordBatch:
        links = list(compare(pa.Table.from_batches(held)))
        columns = zip(*links) if links else ([], [])
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
        edges = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(values[:, a])
            if held and key != current:
                yield flush()
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def _neighbours(per_cent: int, crowd: int):
    """Candidates among consecutive rows of the orders; rows that an order has joined already are not compared again."""

    def compare(rows: pa.Table) -> Iterator[tuple[int, int]]:
        n = rows.num_rows
        if n < 2:
            return
        nodes, tree = rows["node"].to_numpy(), rows["tree"].to_numpy()
        signs = np.frombuffer(b"".join(rows["turned"].to_pylist()), "<u2").reshape(n, -1)
        differ = signs[1:] != signs[:-1]
        prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), signs.shape[1])
        apart = (prefix < LEAST) | (tree[1:] != tree[:-1])
        # The first row that shares enough values with row i: all between them share as many.
        start = np.concatenate([[0], np.maximum.accumulate(np.where(apart, np.arange(1, n), 0))])
        start = np.maximum(start, np.arange(n) - crowd)
        need, joined, group = per_cent * signs.shape[1], _Joined(n), np.arange(n)
        for i in np.flatnonzero(start < np.arange(n)):
            for others in (np.array([i - 1]), np.arange(start[i], i - 1)):
                others = others[group[others] != group[i]]
                if not len(others):
                    continue
                same = np.count_nonzero(signs[others] == signs[i], axis=1)
                met = others[100 * same >= need]
                if len(met):
                    met = met[np.unique(group[met], return_index=True)[1]]
                    joined.join(i, met)
                    seen = group[start[i] : i + 1]
                    seen[np.isin(seen, group[met])] = group[i]
        yield from joined.links(nodes)

    return compare


def _similar_sets(per_cent: int):
    def compare(rows: pa.Table) -> Iterator[tuple[int, int]]:
        n = rows.num_rows
        if n < 2:
            return
        nodes, side = rows["node"].to_numpy(), rows["side"].to_numpy(zero_copy_only=False)
        sets = [shingles(text.as_py()) for text in rows["text"]]
        sizes = np.array([len(s) for s in sets])
        joined = _Joined(n)
        both = bool(side.any())
        # Where each shingle occurs: sorted by shingle, then row.
        whole = np.concatenate(sets)
        rows_of = np.repeat(np.arange(n), sizes)
        shared, number = np.unique(whole, return_inverse=True)
        order = np.argsort(number, kind="stable")
        posted = rows_of[order]
        start = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(shared)))])
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(n):
            own = number[at[i] : at[i + 1]]
            lengths = start[own + 1] - start[own]
            own, lengths = own[lengths > 1], lengths[lengths > 1]
            if not len(own):
                continue
            spots = np.repeat(start[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            common = np.bincount(posted[spots], minlength=n)
            linked = 100 * common >= per_cent * (sizes[i] + sizes - common)
            linked[: i + 1] = False
            if both:
                linked &= side != side[i]
            joined.join(i, np.flatnonzero(linked))
        yield from joined.links(nodes)

    return compare


def _paired(rows: DataFrame, key: Column, blocks: Column, compare) -> DataFrame:
    """Links among the rows of each ``key``, compared block by block.

    With one block a row goes to one task; with more, each row meets every block of its key: once as the first and
    once as the second side. A row's block is a hash of its node.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(
        F.least(F.col("block"), j).alias("first"), F.greatest(F.col("block"), j).alias("second"), (F.col("block") > j).cast("int").alias("side")
    ))
    spread = rows.withColumns({"key": key, "blocks": blocks.cast("long")}).withColumn("block", block).withColumn("cell", F.explode(cells))
    laid = spread.select("key", F.col("cell.first").alias("first"), F.col("cell.second").alias("second"), F.col("cell.side").alias("side"), "node", "text")
    sort = ["key", "first", "second"]
    return arrow_stage(laid.repartition(*sort).sortWithinPartitions(*sort), lambda b: _pairs(b, sort, compare), _LINKS)


def _orders(classes: DataFrame, forest: Forest) -> DataFrame:
    """``tree, turned, node, rank``: the sorted orders, one after the other, of rows that share enough values with another row."""
    at = F.col("tree") * (2 * STRIDE) + 1
    rows = classes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
    # Names only: most rows have no company, and their signatures need not move.
    named = rows.select("node", "tree", F.xxhash64("tree", F.substring("signature", at, F.lit(2 * LEAST))).alias("start"))
    shared = named.groupBy("start").agg(F.count("*").alias("n")).filter("n > 1").select("start")
    whole = F.lit(2 * STRIDE * forest.trees)
    turned = F.concat(F.substring("signature", at, whole), F.substring("signature", F.lit(1), at - 1)).alias("turned")
    found = named.join(shared, "start").join(classes.select("node", "signature"), "node").select("tree", turned, "node")
    return numbered(found, ["tree", "turned", "node"], "orders")


def _candidates(orders: DataFrame, forest: Forest) -> DataFrame:
    """Links among neighbours in the orders. The last rows of a chunk are sent to the next one too, which looks back at them."""
    length = _CHUNK * forest.crowd
    chunk, place = F.floor(F.col("rank") / length), F.col("rank") % length
    chunks = F.when(place >= length - forest.crowd, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    laid = orders.withColumn("chunk", F.explode(chunks)).repartition("chunk").sortWithinPartitions("chunk", "rank")
    return arrow_stage(laid, lambda b: _pairs(b, ["chunk"], _neighbours(forest.estimate, forest.crowd)), _LINKS)


def _decided(rows: DataFrame, forest: Forest) -> DataFrame:
    """``node, doc_id, n_shingles, component_id, kept, first`` for written rows ``node, doc_id, text``; ``node`` is unique.

    ``first`` is true for one row of each component: the one with the smallest id, null last, and among equal ids the smallest node.
    """
    signed = materialize(arrow_stage(rows, _signing(forest.trees), "node long, doc_id long, n_shingles long, digest binary, signature binary"), "signatures")
    classes = materialize(
        signed.filter("n_shingles > 0").groupBy("digest").agg(
            F.min(F.struct("node", "n_shingles", "signature")).alias("of"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("least")
        ).select("digest", "of.node", "of.n_shingles", "of.signature", "least"), "classes",
    )
    regions = materialize(connected(_candidates(_orders(classes, forest), forest)), "regions")
    # Representatives with the size of their region; texts come from the table, for members only.
    members = regions.join(classes.select("node", "n_shingles"), "node")
    sizes = members.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / forest.block), F.ceil(F.sum("n_shingles") / forest.block_shingles)).alias("blocks")
    )
    members = materialize(members.join(sizes, "component").select("node", "component", "blocks"), "members")
    # Merged at any size: the members of a large table are too many to be sent to every task.
    texts = rows.select("node", "text").join(members.hint("merge"), "node")
    links = _paired(texts, F.col("component"), F.col("blocks"), _similar_sets(forest.per_cent))
    joined = connected(links)
    # Components are found among nodes and named by real ids at the end.
    least = joined.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("joint"))
    joint = joined.join(least, "component").select("node", "joint")
    named = classes.select("digest", "node", "least").join(joint, "node", "left").select("digest", F.coalesce("joint", "least").alias("least"))
    # Only classes with links or copies can change a name, but every row asks for its own: a join on digests, split where skewed.
    out = signed.select("node", "doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select(
        "node", "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.coalesce(F.col("node") == F.col("least.node"), F.lit(True)).alias("first"),
    )


def near_duplicates(docs: DataFrame, forest: Forest = Forest(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two texts are linked when 100 times what their shingle sets share is at least ``per_cent`` times what they have together;
    a component is what links connect, named by its smallest id, and that document is kept. A-Z count as a-z. Null and empty texts have
    no shingle and are linked with nothing. Each row is decided by itself, whoever shares its id; a null id comes last in its
    component, whose name is null where no row has an id; rows of a component that share its smallest id are all kept; an empty table gives none.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("node"), F.col(ident).cast("long").alias("doc_id"), text_bytes(F.col(text)).alias("text"))
    return _decided(materialize(rows, "rows"), forest).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, forest: Forest = Forest(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: one row of each component, and every text without shingles.

    The row with the smallest id stays, of those that share it, or have none, the first one as the rows were numbered.
    """
    laid = materialize(docs.withColumn("_node", F.monotonically_increasing_id()), "rows")
    rows = laid.select(F.col("_node").alias("node"), F.col(ident).cast("long").alias("doc_id"), text_bytes(F.col(text)).alias("text"))
    gone = _decided(rows, forest).filter("not first").select(F.col("node").alias("_gone"))
    return laid.join(gone.hint("merge"), F.col("_node") == F.col("_gone"), "left_anti").select(*docs.columns)
