"""Removing benchmark text from training documents.

The windows of all benchmark items form a hash set that is sent to the tasks in slices of a fixed number of windows: a benchmark
within one slice is scanned for in one pass, a larger one in one pass per slice, so a broadcast never outgrows its bound, nor do those alive at a time. In
a task each document's words become numbers of the slice's vocabulary, windows of numbers are hashed all at once, and
the few whose hash is in the set are confirmed word by word.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_stage, text_bytes
from glyphmill.scratch import materialize
from glyphmill.worker import kept

#: Consecutive words of a window.
WINDOW = 10
#: Windows that one broadcast holds; some 30 MB of Python objects.
SLICE = 100_000
#: Broadcasts that are alive at a time.
CHAIN = 4
#: Letters, digits and everything outside ASCII make words; A-Z are lowered first.
_AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RUN = re.compile(rb"[^ ]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20

_WINDOWS = "item_id string, n int, words binary"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_AS_WORDS).split()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            n = min(WINDOW, len(words))
            out += [(item, n, b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)] if n else []
        columns = list(zip(*out)) if out else [[], [], []]
        yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["item_id", "n", "words"])


class Windows:
    """A slice of the windows, ready to be searched for."""

    def __init__(self, items: dict[bytes, list[str | None]]):
        self.items = items
        self.number: dict[bytes, int] = {}
        self.by_length: dict[int, np.ndarray] = {}
        hashes: dict[int, list[int]] = {}
        for window in items:
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in window.split()]
            hashes.setdefault(len(numbers), []).append(int(_hashed(np.array(numbers, np.uint64), len(numbers))[0]))
        for n, values in hashes.items():
            self.by_length[n] = np.zeros(1 << _BITS, bool)
            self.by_length[n][np.array(values, np.uint64) >> np.uint64(64 - _BITS)] = True

    def find(self, words: list[bytes]) -> list[tuple[int, bytes]]:
        """Start and words of every occurrence of a window."""
        get = self.number.get
        numbers = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = numbers > 0
        runs = np.concatenate([[0], np.cumsum(~known)])
        out = []
        for n, marked in self.by_length.items():
            if len(words) < n:
                continue
            # Only where all words are of the vocabulary can a window begin.
            starts = np.flatnonzero(runs[n:] == runs[: len(words) - n + 1])
            if len(starts):
                hits = starts[marked[_hashed(numbers, n)[starts] >> np.uint64(64 - _BITS)]]
                for i in hits.tolist():
                    window = b" ".join(words[i : i + n])
                    if window in self.items:
                        out.append((i, window))
        return out


def _hashed(numbers: np.ndarray, n: int) -> np.ndarray:
    last = len(numbers) - n + 1
    out = numbers[:last].copy()
    for i in range(1, n):
        out *= _FACTOR
        out += numbers[i : last + i]
    out *= _FACTOR
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _scan(broadcast, key: str):
    """Adds what a slice finds to what the slices before it have found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = kept(key, lambda: Windows(broadcast.value))
        for batch in batches:
            text, spans, items = (batch.column(batch.schema.get_field_index(c)) for c in ("_dc_text", "_dc_spans", "_dc_items"))
            all_spans, all_items, counts = [], [], []
            for t, s, i in zip(text, spans, items):
                words = words_of(t.as_py())
                hits = windows.find(words)
                counts.append(len(words))
                if hits:
                    all_spans.append(_merged([(x["first"], x["last"]) for x in s.as_py()] + [(at, at + w.count(b" ")) for at, w in hits]))
                    all_items.append(sorted({*i.as_py(), *(x for _, w in hits for x in windows.items[w])}, key=lambda x: (x is None, x or "")))
                else:
                    all_spans.append([(x["first"], x["last"]) for x in s.as_py()])
                    all_items.append(i.as_py())
            found = {
                "_dc_words": pa.array(counts, pa.int64()),
                "_dc_spans": pa.array([[{"first": a, "last": b} for a, b in s] for s in all_spans], _SPANS),
                "_dc_items": pa.array(all_items, pa.list_(pa.string())),
            }
            names = batch.schema.names
            yield pa.record_batch([found.get(n, batch.column(k)) for k, n in enumerate(names)], names)

    return scan


def window_slices(benchmark: DataFrame, ident: str = "item_id", text: str = "text", size: int = SLICE) -> Iterator[dict[bytes, list[str | None]]]:
    """The distinct windows with the items that have them, cut by hash into dictionaries of about ``size`` entries.

    A null, last, stands for all items without an id.
    """
    made = arrow_stage(benchmark.select(F.col(ident).cast("string"), text_bytes(F.col(text))), _windows, _WINDOWS)
    windows = materialize(made.select("item_id", "words").distinct(), "windows")
    n = -(-windows.count() // size)
    for k in range(n):
        part = windows.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == k).groupBy("words").agg(
            F.collect_set("item_id").alias("items"), F.max(F.col("item_id").isNull()).alias("unnamed")
        )
        yield {bytes(r["words"]): sorted(r["items"]) + [None] * r["unnamed"] for r in part.toLocalIterator()}


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, columns: list[str], slice_size: int = SLICE) -> DataFrame:
    """``columns`` of ``docs`` with ``_dc_words, _dc_spans, _dc_items``, names apart from those that documents have.

    Every ``CHAIN`` slices what was found is written and their broadcasts are dropped, so a benchmark of any size holds no more at a time.
    """
    context = docs.sparkSession.sparkContext
    nothing = {"_dc_words": F.size(F.array()).cast("long"), "_dc_spans": F.array().cast("array<struct<first:int,last:int>>"), "_dc_items": F.array().cast("array<string>")}
    out = docs.select(*columns, text_bytes(F.col(text)).alias("_dc_text")).withColumns(nothing)
    alive = []
    for windows in window_slices(benchmark, size=slice_size):
        if len(alive) == CHAIN:
            out = materialize(out, "searched")
            while alive:
                alive.pop().destroy()
        alive.append(context.broadcast(windows))
        out = arrow_stage(out, _scan(alive[-1], f"windows:{uuid.uuid4().hex}"), out.schema)
    if not alive:  # no window to look for: only the words are counted
        out = arrow_stage(out, _scan(context.broadcast({}), f"windows:{uuid.uuid4().hex}"), out.schema)
    return out.drop("_dc_text")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, slice_size: int = SLICE) -> DataFrame:
    """``docs`` (or the columns ``keep`` of them) with ``n_words``, ``n_hit``, ``spans``, ``item_ids`` and ``unnamed_item``.

    ``spans`` are maximal runs of hit words (first and last index), ``item_ids`` the items with a window in the text, in string
    order. Null and empty texts have no words; an item without words has no window, those of an item without an id
    are hit like others, which ``unnamed_item`` tells in place of ``item_ids``; equal items and repeated rows are each reported; an empty table gives none; columns of ``docs`` with the new names are replaced. Whole texts are scanned.
    """
    columns = [c for c in (keep or docs.columns) if c not in ("n_words", "n_hit", "spans", "item_ids", "unnamed_item")]
    out = _searched(docs, benchmark, text, columns, slice_size)
    n_hit = F.aggregate("_dc_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    named = F.filter("_dc_items", lambda x: x.isNotNull())
    unnamed = F.coalesce(F.exists("_dc_items", lambda x: x.isNull()), F.lit(False))
    return out.select(*columns, F.col("_dc_words").alias("n_words"), n_hit.alias("n_hit"), F.col("_dc_spans").alias("spans"), named.alias("item_ids"), unnamed.alias("unnamed_item"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit word; their columns, whatever their names, stay as they are.

    Null and empty texts have no words and stay; repeated rows go or stay together; an empty benchmark removes nothing.
    """
    return _searched(docs, benchmark, text, docs.columns).filter(F.size("_dc_spans") == 0).select(*docs.columns)


def _cut(text: bytes, spans: list[dict]) -> bytes:
    at = [m.span() for m in _RUN.finditer(text.translate(_AS_WORDS))]
    out, done = [], 0
    for s in spans:
        out.append(text[done : at[s["first"]][0]])
        done = at[s["last"]][1]
    return b"".join(out) + text[done:]


def _cutting(text: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = dict(zip(names, batch.columns))
            spans = columns.pop("_dc_spans")
            columns[text] = pa.array(
                [None if not t.is_valid else _cut(t.as_py().encode(), s.as_py()).decode() if len(s) else t.as_py() for t, s in zip(columns[text], spans)], pa.string()
            )
            yield pa.record_batch(list(columns.values()), list(columns))

    return cut


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All rows of ``docs``, with the hit words and what stands between them cut out of the text; other columns, whatever their names, stay.

    Null and empty texts stay as they are; repeated rows are cut alike; an empty table gives none.
    """
    found = _searched(docs, benchmark, text, docs.columns).select(*docs.columns, "_dc_spans")
    return arrow_stage(found, _cutting(text), docs.schema)
