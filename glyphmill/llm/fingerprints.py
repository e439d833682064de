"""Document fingerprints that add up: a homomorphic multiset hash of paragraphs.

A paragraph is what stands between line feeds. Each is hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo 2 to the 32. So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding
or subtracting its vector, without the rest of the text. The vector has two sections:

* ``STRICT`` lanes are uniform digests of the whole paragraph. Texts with other paragraphs differ there.
* ``ALIKE`` lanes are signs, plus or minus a weight, of the pieces (about sentences) of the paragraph. The squared difference of
  two fingerprints in these lanes estimates how much text only one of them has, and yields a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_stage, text_bytes
from glyphmill.scratch import materialize

#: Lanes of 32 bits: digests of paragraphs, and signs of pieces.
STRICT, ALIKE = 64, 512
LANES = STRICT + ALIKE
#: Pieces end after sentence marks; longer ones, in bytes, are cut further after words chosen by their content.
_PIECE = re.compile(rb"[^.!?]+[.!?]*|[.!?]+")
_LONG = 400
_WORD = re.compile(rb"[^ ]* ?")


def paragraphs(text: bytes) -> list[bytes]:
    """What line feeds separate; an empty text has none."""
    return text.split(b"\n") if text else []


def pieces(paragraph: bytes) -> Iterator[bytes]:
    for piece in _PIECE.findall(paragraph):
        if len(piece) <= _LONG:
            yield piece
            continue
        start = 0
        for word in _WORD.finditer(piece):
            if word.end() > start and xxhash.xxh3_64_intdigest(word.group()) % 16 == 0:
                yield piece[start : word.end()]
                start = word.end()
        if start < len(piece):
            yield piece[start:]


def vector(found: list[bytes]) -> np.ndarray:
    """The sum of the vectors of some paragraphs."""
    out = np.zeros(LANES, np.uint32)
    if not found:
        return out
    digests = np.frombuffer(b"".join([hashlib.shake_128(p).digest(4 * STRICT) for p in found]), "<u4").reshape(len(found), STRICT)
    out[:STRICT] = digests.sum(axis=0, dtype=np.uint32)
    parts = [piece for p in found for piece in pieces(p)]
    # In blocks, so that a very long text needs no more memory than a short one.
    for i in range(0, len(parts), 4096):
        block = parts[i : i + 4096]
        bits = np.unpackbits(np.frombuffer(b"".join([hashlib.blake2b(p).digest() for p in block]), np.uint8).reshape(len(block), 64), axis=1)
        weights = np.sqrt(np.fromiter(map(len, block), np.float64, len(block))).round()
        # Sums of small whole numbers: exact in floating point, whatever the order.
        signed = 2.0 * (weights @ bits.astype(np.float64)) - weights.sum()
        out[STRICT:] += signed.astype(np.int64).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else about twice the text that both have over the text that each has; never under 0."""
    if (a == b).all():
        return 1.0
    x, y = a[STRICT:].view(np.int32).astype(np.float64), b[STRICT:].view(np.int32).astype(np.float64)
    apart = (a[STRICT:] - b[STRICT:]).view(np.int32).astype(np.float64)
    whole = (x * x).sum() + (y * y).sum()
    return float(min(1.0, max(0.0, 1.0 - (apart * apart).sum() / whole))) if whole else 0.0


def _each(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield x.as_py() or b""


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [vector(paragraphs(t)).tobytes() for t in _each(batch.column("_text"))]
        yield _with(batch, "_text", {"fingerprint": pa.array(made, pa.binary())})


def _with(batch: pa.RecordBatch, without: str, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != without]
    return pa.record_batch([*(batch.column(n) for n in names), *new.values()], [*names, *new])


def _fields(df: DataFrame, *without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name not in without)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the lanes as little-endian 32-bit integers.

    Null and empty texts have no paragraph and the zero vector; whole texts are hashed; repeated rows are alike; an empty table gives none;
    a column of ``docs`` named ``fingerprint`` is replaced.
    """
    given = docs.drop("fingerprint").withColumn("_text", text_bytes(F.col(text)))
    return arrow_stage(given, _vectors, _fields(given, "_text") + "fingerprint binary")


def _changing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for was, less, more in zip(*(batch.column(c) for c in ("fingerprint", "_less", "_more"))):
            of = lambda found: vector([p.encode() for p in found.as_py() or [] if p is not None])
            base = np.frombuffer(was.as_py(), "<u4") if was.is_valid else np.zeros(LANES, np.uint32)
            out.append((base - of(less) + of(more)).tobytes())
        names = [n for n in batch.schema.names if n not in ("_less", "_more")]
        yield pa.record_batch([pa.array(out, pa.binary()) if n == "fingerprint" else batch.column(n) for n in names], names)


def changed(rows: DataFrame, deleted: Column, inserted: Column) -> DataFrame:
    """``rows`` with their ``fingerprint`` after paragraphs (arrays of strings) are deleted and inserted; the texts are not needed.

    A null array changes nothing, a null fingerprint counts as that of an empty text. What is deleted is taken to have been there.
    """
    given = rows.withColumns({"_less": deleted, "_more": inserted})
    return arrow_stage(given, _changing, rows.schema)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[object, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["_key", "_sum"])

    for batch in batches:
        for key, made in zip(batch.column("_key"), batch.column("fingerprint")):
            k = key.as_py()
            if k not in sums:
                if len(sums) == 4096:
                    yield flush()
                    sums = {}
                sums[k] = np.zeros(LANES, np.uint32)
            if made.is_valid:
                sums[k] += np.frombuffer(made.as_py(), "<u4")
    if sums:
        yield flush()


def totals(rows: DataFrame, by: str) -> DataFrame:
    """``by, fingerprint``: the fingerprint of all paragraphs of each group, from the rows' ``fingerprint``.

    ``by`` is read as a string; null is a group of its own. Tasks add up what they have first, in memory for some 4,096 groups,
    so a group that holds most rows sends one vector a task; its lanes are then summed by Spark.
    """
    partial = arrow_stage(rows.select(F.col(by).cast("string").alias("_key"), "fingerprint"), _partial_sums, "_key string, _sum binary")
    digits = F.hex("_sum")
    # Little-endian lanes as numbers.
    lanes = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.conv(F.concat(*[F.substring(digits, i * 8 + 7 - 2 * j, F.lit(2)) for j in range(4)]), 16, 10).cast("long"))
    summed = partial.select("_key", F.posexplode(lanes).alias("lane", "n")).groupBy("_key", "lane").agg(F.pmod(F.sum("n"), F.lit(1 << 32)).alias("n"))
    big = F.lpad(F.hex("n"), 8, "0")
    little = F.concat(*[F.substring(big, 7 - 2 * j, 2) for j in range(4)])
    whole = summed.groupBy("_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lane", little.alias("h")))), lambda s: s["h"]), "").alias("h"))
    return whole.select(F.col("_key").alias(by), F.unhex("h").alias("fingerprint"))


# A row's own fingerprint and that of its edited text, in which the start of the next row's text stands in for its second half.

_EDITED = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


class _Row:
    """A text, cut where its second half begins, with the sums of the paragraphs before and from there."""

    def __init__(self, ident: int | None, raw: bytes):
        self.ident, self.raw = ident, raw
        self.text = raw.decode("utf-8", "replace")
        n = len(self.text)
        self.chars, self.head = n, self.text[: n - n // 2]
        found = paragraphs(self.text.encode())
        #: Paragraphs that end before the cut: an edit leaves them alone.
        self.whole = self.head.count("\n")
        self.before = vector(found[: self.whole])
        self.sum = self.before + vector(found[self.whole :])

    def edited(self, after: _Row) -> tuple:
        text = (self.head + after.text[: self.chars // 2]).encode()
        edited = self.before + vector(paragraphs(text)[self.whole :])
        near = (likeness(self.sum, edited), likeness(self.sum, after.sum))
        return (self.ident, self.chars, hashlib.sha256(text).digest(), _digest(self.sum), _digest(edited), *near)


def _digest(lanes: np.ndarray) -> bytes:
    return hashlib.sha256(lanes.astype("<u4").tobytes()).digest()


def _batch(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
    """Finished rows, then edges ``(part, first, ident, text)`` that wait for a row of another task."""
    columns = [[*c, *[None] * len(edges)] for c in (zip(*rows) if rows else [[]] * len(_KINDS))]
    ends = [[*[None] * len(rows), *c] for c in (zip(*edges) if edges else [[]] * 4)]
    kinds = [*_KINDS, pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip([*columns, *ends], kinds)], [*_names(_EDITED), "part", "first", "ident", "text"])


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        rows, edges = [], []
        for ident, text in zip(batch.column(0).to_pylist(), _each(batch.column(1))):
            row = _Row(ident, text)
            if held is None:
                edges.append((part, True, ident, text))
            else:
                rows.append(held.edited(row))
            held = row
        yield _batch(rows, edges)
    if held is not None:
        yield _batch([], [(part, False, held.ident, held.raw)])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_Row(i, t).edited(_Row(None, a)) for i, t, a in zip(batch.column(0).to_pylist(), _each(batch.column(1)), _each(batch.column(2)))]
        yield _batch(rows, []).select(_names(_EDITED))


def edits(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's fingerprint beside that of its text edited with the row after it, in descending order of ``ident``.

    The last floor(n / 2) code points of a text of n are replaced by the first as many, or all, of the next one; the first row follows the
    last. Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (SHA-256 of the lanes), ``near_edited, near_next``.
    Null ids come last and ties are in order of a digest of the text; null texts count as empty; a row alone follows itself; repeated rows are rows like others;
    an empty table gives none. Other columns of ``docs`` are not read.

    Texts are shuffled once, by ranges of ids. A task goes through its rows in order and holds two at a time; what is left are the
    first and last row of each task, written and joined by the tasks' order.
    """
    given = docs.select(F.col(ident).cast("long").alias("doc_id"), text_bytes(F.col(text)).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    laid = given.repartitionByRange(*order).sortWithinPartitions(*order)
    made = materialize(arrow_stage(laid, _in_order, f"{_EDITED}, part int, first boolean, ident long, text binary"), "fingerprints")
    whole = made.filter("part is null").select(*_names(_EDITED))
    # One row for each task: which task's first row follows its last one; the first task's follows the last's.
    parts = made.filter("first").select("part")
    by_part = W.orderBy("part")
    follow = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(W.partitionBy(F.lit(0)))).alias("next"))
    lasts = made.filter("not first").select("part", "ident", "text").join(follow, "part")
    firsts = made.filter("first").select(F.col("part").alias("next"), F.col("text").alias("after"))
    pairs = lasts.join(firsts, "next").select("ident", "text", "after")
    return whole.unionByName(arrow_stage(pairs, _across, _EDITED))
