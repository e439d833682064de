"""Token ids in binary files: blocks of ids cut into byte or bit planes, each plane compressed, with a chunk index.

A file holds, one after the other: a magic string; the planes of every block, lowest first, each a zstandard frame;
the document table (ids, a byte each for null ids, lengths), as three frames; the chunk index, one row of
``(first id, ids, planes, offset)`` per block and the sizes of all planes; and a fixed trailer that tells where those are.
Neighbouring ids share their high planes, which compress to almost nothing, while the low ones stay cheap to store.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm import vocab
from glyphmill.llm.common import arrow_stage, text_bytes
from glyphmill.scratch import materialize
from glyphmill.sources.tree import _filesystem

MAGIC = b"PLANES01"
_TRAILER = struct.Struct("<QQQQ8s")  # documents, blocks, offset of the document table, offset of the chunk index, magic
_MANIFEST = "part int, number int, path string, n_docs long, n_ids long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first; those above the highest id are left out."""
    top = int(ids.max(initial=0)).bit_length()
    if not bits:
        return [(ids >> np.uint32(8 * i)).astype(np.uint8).tobytes() for i in range(max(1, (top + 7) // 8))]
    return [np.packbits((ids >> np.uint32(i)).astype(np.uint8) & 1, bitorder="little").tobytes() for i in range(max(1, top))]


def ids_of(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a block from its planes."""
    out = np.zeros(n, "<u4")
    for i, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if bits:
            raw = np.unpackbits(raw, count=n, bitorder="little")
        out |= raw.astype("<u4") << np.uint32(i if bits else 8 * i)
    return out


class Writer:
    """One file, written from front to back; holds a block of ids and the document table in memory."""

    def __init__(self, out, block: int, bits: bool, level: int = 3):
        self.out, self.block, self.bits = out, block, bits
        self.packed = zstandard.ZstdCompressor(level=level)
        self.at, self.n_ids = 0, 0
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.waiting_bytes = 0
        self.index: list[tuple[int, int, int, int]] = []
        self.sizes: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.waiting_bytes += len(ids)
        if self.waiting_bytes >= 4 * self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            part = ids[i : min(i + self.block, whole)]
            planes = planes_of(part, self.bits)
            self.index.append((self.n_ids, len(part), len(planes), self.at))
            self.sizes += [self._put(self.packed.compress(p)) for p in planes]
            self.n_ids += len(part)
        self.waiting = [ids[whole:].tobytes()] if whole < len(ids) else []
        self.waiting_bytes = 4 * (len(ids) - whole)

    def close(self) -> None:
        self._flush(last=True)
        table = self.at
        columns = (
            np.array([d or 0 for d in self.docs], "<i8"), np.array([d is None for d in self.docs], np.uint8), np.array(self.lengths, "<u8"),
        )
        for column in columns:
            frame = self.packed.compress(column.tobytes())
            self._put(struct.pack("<Q", len(frame)))
            self._put(frame)
        index = self.at
        self._put(np.array(self.index, "<u8").tobytes())
        self._put(np.array(self.sizes, "<u8").tobytes())
        self._put(_TRAILER.pack(len(self.docs), len(self.index), table, index, MAGIC))


class Reader:
    """Random access to the blocks of a file; ``f`` is a seekable file."""

    def __init__(self, f, size: int, bits: bool):
        self.f, self.bits = f, bits
        self.unpacked = zstandard.ZstdDecompressor()
        n_docs, blocks, table, index, magic = _TRAILER.unpack(self._bytes(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token planes")
        raw = np.frombuffer(self._bytes(index, size - _TRAILER.size - index), "<u8").astype(np.int64)
        self.blocks, self.sizes = raw[: 4 * blocks].reshape(-1, 4), raw[4 * blocks :]
        self.first_plane = np.concatenate([[0], np.cumsum(self.blocks[:, 2])])
        columns = []
        for kind in ("<i8", np.uint8, "<u8"):
            (n,) = struct.unpack("<Q", self._bytes(table, 8))
            columns.append(np.frombuffer(self.unpacked.decompress(self._bytes(table + 8, n)), kind))
            table += 8 + n
        ids, missing, self.lengths = columns
        self.docs = [None if gone else int(d) for d, gone in zip(ids, missing)]
        assert len(self.docs) == n_docs

    def _bytes(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def block(self, k: int) -> np.ndarray:
        _, n, _, at = self.blocks[k]
        sizes = self.sizes[self.first_plane[k] : self.first_plane[k + 1]]
        raw, planes, done = self._bytes(int(at), int(sizes.sum())), [], 0
        for size in sizes:
            planes.append(self.unpacked.decompress(raw[done : done + int(size)]))
            done += int(size)
        return ids_of(planes, int(n), self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """``doc_id``, first position, length and crc32 of each document; one block is in memory at a time."""
        k, block, used, start = 0, np.zeros(0, "<u4"), 0, 0
        for doc, length in zip(self.docs, map(int, self.lengths)):
            left, crc = length, 0
            while left:
                if used == len(block):
                    block, k, used = self.block(k), k + 1, 0
                n = min(left, len(block) - used)
                crc = zlib.crc32(block[used : used + n].tobytes(), crc)
                left, used = left - n, used + n
            yield doc, start, length, crc
            start += length


def _writer(root: str, tokenizer: str, end: bytes, block: int, ids_per_file: int, bits: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = vocab.byte_bpe(tokenizer), TaskContext.get().partitionId()
        system, folder = _filesystem(root)
        staged = system.type_name in ("local", "hdfs")
        made: list[tuple] = []
        out = writer = None
        target = ""

        def finish():
            writer.close()
            out.close()
            name = f"part-{part:06d}-{len(made):05d}.planes"
            if staged:  # a second attempt of a task replaces a file by an equal one
                system.move(target, f"{folder}/{name}")
            made.append((part, len(made), f"{root}/{name}", len(writer.docs), writer.n_ids))

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), (t.as_py().decode("utf-8", "replace") for t in batch.column(1)))
            for group in vocab.in_groups(rows, lambda row: len(row[1])):
                for (doc, _), ids in zip(group, bpe.encode([t for _, t in group])):
                    if writer is None:
                        system.create_dir(folder, recursive=True)
                        target = f"{folder}/.{uuid.uuid4().hex}.tmp" if staged else f"{folder}/part-{part:06d}-{len(made):05d}.planes"
                        out = system.open_output_stream(target)
                        writer = Writer(out, block, bits)
                    writer.add(doc, ids + end)
                    if writer.n_ids + writer.waiting_bytes // 4 >= ids_per_file:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        names = ["part", "number", "path", "n_docs", "n_ids"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*made) if made else [[]] * 5, kinds)], names)

    return write


def write_token_files(
    docs: DataFrame, root: str, tokenizer: str, end_id: int, ident: str = "doc_id", text: str = "text",
    block: int = 65_536, ids_per_file: int = 1 << 25, bits: bool = False,
) -> DataFrame:
    """Encode every text, close it with ``end_id`` and write all ids in ascending order of ``ident``.

    Returns the committed files in order, ``path, n_docs, n_ids, start``: what a lost or repeated task leaves behind is
    not in it. Rows are laid out by range, so files follow each other in document order; a null id comes first, rows with one id
    are ordered by the size of their text, then by the text; a null text is empty. An empty table gives no file.
    """
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), text_bytes(F.col(text)).alias("text"))
    size = F.octet_length("text")
    laid = rows.repartitionByRange("doc_id", size).sortWithinPartitions("doc_id", size, "text")
    write = _writer(root, tokenizer, struct.pack("<I", end_id), block, ids_per_file, bits)
    manifest = materialize(arrow_stage(laid, write, _MANIFEST), "token-files")
    before = F.sum("n_ids").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))  # one row per file
    return manifest.select("path", "n_docs", "n_ids", F.coalesce(before, F.lit(0)).alias("start"))


def _reader(bits: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = _filesystem(path)
                with system.open_input_file(inner) as f:
                    rows = [(doc, start + at, n, crc) for doc, at, n, crc in Reader(f, f.size(), bits).documents()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(files: DataFrame, bits: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone, a task per file."""
    n = max(1, files.count())
    return arrow_stage(files.select("path", "start").repartition(n), _reader(bits), _READ)
