"""Aligning the tokens of two tokenizers over the same bytes.

Tokenizer A (byte-level) reads a space and the text, tokenizer B (sentence pieces) the text, before which it puts a space itself. Where a token
of A and one of B end at the same byte, a *group* ends; the two tokens are *linked*.

Fragments. Any range of bytes yields a fragment: the tokens that end in it, as an open prefix (up to its first common end), closed
groups, and an open suffix (after its last). Fragments of neighbouring ranges compose, a suffix and the next prefix closing to a group,
and composition is associative. So a very long document is cut into ranges that different tasks tokenise, and a tree of
groupings, ``FAN`` fragments at a time, composes them.

Exactness. Tokens of a range must be those of the whole text. Both vocabularies never join a token over a single space between
two visible characters (A begins a piece there, B has no piece with a space inside, which is checked), so a range is
tokenised from the last such place before it to the first one after it. The same places cut a text into units (mostly words) that a task
aligns once and remembers.

Corpus counts. How often two ids are linked is counted over all documents. Of the pairs, those with at least the 2 to the 18th part of all
links, of which there can't be more than that, are sent to the tasks; the rest meet the documents in a join without hot keys.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import vocab
from glyphmill.llm.common import arrow_stage, text_bytes
from glyphmill.scratch import materialize
from glyphmill.worker import kept

#: Bytes of a range of a long document, and fragments that one step of the tree composes.
RANGE, FAN = 1 << 15, 16
#: Pairs that are sent to the tasks, at most: 2 MB.
HOT = 1 << 18
#: A place at which both tokenizers begin a new token, whatever comes before and after.
_CUT = re.compile(r"(?<![ ▁]) (?=\S)")
#: Texts that are not simply cut at all their spaces.
_ODD = re.compile(r" (?=\s|\Z)|▁")
#: The same in bytes: what follows is visible for sure.
_CUT_BYTES = re.compile(rb"(?<![ \x81]) (?=[!-~\xc3-\xe0\xe4-\xf4])")
#: Ids of B fit in this many bits of a pair.
_B_BITS = 15


@dataclass(frozen=True)
class Fragment:
    """What a range of bytes adds. Tokens are their ids with commas; without a common end (``cut``) all are in the prefix."""

    cut: bool = False
    pre_a: str = ""
    pre_b: str = ""
    closed: str = ""
    suf_a: str = ""
    suf_b: str = ""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    #: Linked pairs, sorted, as 32-bit numbers, and how often each occurs.
    pairs: bytes = b""
    times: bytes = b""
    #: The tokens' bytes differ from the text.
    differs: bool = False

    def then(self, other: Fragment) -> Fragment:
        """The fragment of both ranges, of which ``other`` is the later one."""
        pairs, times = _added([(self.pairs, self.times), (other.pairs, other.times)])
        sums = {
            "n_a": self.n_a + other.n_a, "n_b": self.n_b + other.n_b, "n_groups": self.n_groups + other.n_groups,
            "pairs": pairs, "times": times, "differs": self.differs or other.differs,
        }
        if not self.cut:
            return replace(other, pre_a=_comma(self.pre_a, other.pre_a), pre_b=_comma(self.pre_b, other.pre_b), **sums)
        if not other.cut:
            return replace(self, suf_a=_comma(self.suf_a, other.pre_a), suf_b=_comma(self.suf_b, other.pre_b), **sums)
        closing = f"{_comma(self.suf_a, other.pre_a)}|{_comma(self.suf_b, other.pre_b)}"
        return Fragment(
            True, self.pre_a, self.pre_b, ";".join([x for x in (self.closed, closing, other.closed) if x]), other.suf_a, other.suf_b, **sums
        )

    def groups(self) -> str:
        """All groups of a whole document, whose last byte ends one."""
        return ";".join([x for x in (f"{self.pre_a}|{self.pre_b}" if self.cut else "", self.closed) if x])


def _comma(x: str, y: str) -> str:
    return f"{x},{y}" if x and y else x or y


def _added(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """Counts of pairs, added up."""
    parts = [p for p in parts if p[0]]
    if len(parts) < 2:
        return parts[0] if parts else (b"", b"")
    pairs, at = np.unique(np.concatenate([np.frombuffer(p, "<u4") for p, _ in parts]), return_inverse=True)
    times = np.zeros(len(pairs), "<i8")
    np.add.at(times, at, np.concatenate([np.frombuffer(t, "<i8") for _, t in parts]))
    return pairs.astype("<u4").tobytes(), times.tobytes()


def _counted(pairs: bytes) -> tuple[bytes, bytes]:
    if not pairs:
        return b"", b""
    found, times = np.unique(np.frombuffer(pairs, "<u4"), return_counts=True)
    return found.tobytes(), times.astype("<i8").tobytes()


def _byte_of() -> dict[str, int]:
    """The bytes that the printable characters of a byte-level vocabulary stand for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers, with a bounded memory of units already aligned."""

    def __init__(self, a: str, b: str, size: int = 150_000):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_file(vocab.default_path(a))
        # Strings of special tokens are plain text.
        self.a.encode_special_tokens = True
        self.b = vocab.pieces(b)
        as_byte = _byte_of()
        self.bytes_a = {i: bytes(as_byte.get(c, 63) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_b: list[bytes] = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:5], 16)]))
            else:
                if "▁" in piece.lstrip("▁"):
                    raise ValueError("a piece with a space inside: texts can't be cut at spaces")
                self.bytes_b.append(piece.replace("▁", " ").encode())
        if self.b.get_piece_size() > 1 << _B_BITS or max(self.bytes_a) >= 1 << (32 - _B_BITS):
            raise ValueError("ids too large for a pair of 32 bits")
        self.bytes_a = [self.bytes_a.get(i, b"") for i in range(max(self.bytes_a) + 1)]
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        #: What a token is in the list of groups: its id times 4 plus 0 or 1 for A, 2 or 3 for B, the odd ones last in their group.
        self.shown = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|,;"]
        # Units without their space, and their tokens so packed in 32 bits each; none if bytes differ. Two generations: what the younger one
        # lacks is taken over from the elder, which is dropped in time.
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.most = size

    def tokens(self, spaced: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """Ids and ends in bytes of the tokens of both, for text that begins with a space; whether all bytes are right."""
        a, b = self.a.encode(spaced, add_special_tokens=False).ids, self.b.encode(spaced[1:])
        raw = spaced.encode()
        same = b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return a, np.cumsum(self.length_a[a]), b, np.cumsum(self.length_b[b]), same

    def fragment(self, unit: str, low: int, high: int) -> Fragment:
        """The fragment of the tokens of ``unit`` that end after byte ``low`` and not after ``high``."""
        a, ends_a, b, ends_b, same = self.tokens(unit)
        if not same:
            return Fragment(differs=True)
        in_a, in_b = (ends_a > low) & (ends_a <= high), (ends_b > low) & (ends_b <= high)
        a, ends_a, b, ends_b = a[in_a], ends_a[in_a], b[in_b], ends_b[in_b]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cuts_a, cuts_b = np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")
        linked = (a[cuts_a - 1] << _B_BITS | b[cuts_b - 1]).astype("<u4")
        listed = lambda ids, cuts: [",".join(map(str, part)) for part in np.split(ids, cuts)]
        of_a, of_b = listed(a, cuts_a), listed(b, cuts_b)
        pairs, times = _counted(linked.tobytes())
        numbers = {"n_a": len(a), "n_b": len(b), "n_groups": len(common), "pairs": pairs, "times": times}
        if not len(common):
            return Fragment(False, of_a[0], of_b[0], **numbers)
        closed = ";".join([f"{x}|{y}" for x, y in zip(of_a[1:-1], of_b[1:-1])])
        return Fragment(True, of_a[0], of_b[0], closed, of_a[-1], of_b[-1], **numbers)

    def _aligned(self, units: list[str]) -> list[bytes]:
        """The packed tokens of units, which are encoded together: each begins where both tokenizers begin a token."""
        a, ends_a, b, ends_b, same = self.tokens("".join([" " + u for u in units]))
        if not same:
            return [x for u in units for x in self._aligned([u])] if len(units) > 1 else [b""]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        packed = np.empty(len(a) + len(b), "<u4")
        # A group's tokens of A stand after those of B in the groups before it, its tokens of B after those of A up to it.
        packed[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = a * 4 + (common[of_a] == ends_a)
        packed[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = b * 4 + 2 + (common[of_b] == ends_b)
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        until = 4 * (np.searchsorted(ends_a, ends, "right") + np.searchsorted(ends_b, ends, "right"))
        raw, until = packed.tobytes(), until.tolist()
        return [raw[x:y] for x, y in zip([0, *until], until)]

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """What is not known yet; kept, but for long units and those that stand nowhere but at the ends of a text."""
        out, new, alone = {}, [], []
        for u in units:
            if u in self.elder:
                self.known[u] = self.elder[u]
            elif u[:1].isspace() or u[-1:] in (" ", "▁") or not u:
                alone.append(u)
            else:
                new.append(u)
        for u in alone:
            out[u] = self._aligned([u])[0]
        for i in range(0, len(new), 500):
            block = new[i : i + 500]
            for u, found in zip(block, self._aligned(block)):
                (self.known if len(u) <= 64 else out)[u] = found
        return out

    def documents(self, texts: list[str]) -> list[Fragment]:
        """The fragments of whole texts, each of which begins with a space."""
        if len(self.known) > self.most:
            self.known, self.elder = {}, self.known
        cut, missing = [], set()
        for spaced in texts:
            units = spaced.split(" ")[1:]
            if _ODD.search(spaced):
                at = [0, *(m.start() for m in _CUT.finditer(spaced) if m.start()), len(spaced)]
                units = [spaced[x + 1 : y] for x, y in zip(at, at[1:])]
            cut.append(units)
            missing.update(units)
        missing = {u for u in missing if u not in self.known}
        rare = self._learn(missing) if missing else {}
        out = []
        for units in cut:
            found = list(map(self.known.get, units))
            if None in found:
                found = [rare[u] if f is None else f for f, u in zip(found, units)]
            out.append(Fragment(differs=True) if b"" in found else self._listed(np.frombuffer(b"".join(found), "<u4")))
        return out

    def _listed(self, packed: np.ndarray) -> Fragment:
        kind = packed & 3
        shown = "".join([self.shown[x] for x in packed.tolist()])
        first, _, closed = shown[:-1].partition(";")
        pre_a, _, pre_b = first.partition("|")
        ends_a, ends_b = packed[kind == 1] >> 2, packed[kind == 3] >> 2
        n_a = int((kind < 2).sum())
        return Fragment(True, pre_a, pre_b, closed, "", "", n_a, len(packed) - n_a, len(ends_a), *_counted((ends_a << _B_BITS | ends_b).tobytes()))

    def document(self, spaced: str) -> Fragment:
        return self.documents([spaced])[0]

    def part(self, spaced: str, start: int, low: int, high: int) -> Fragment:
        """The fragment of the bytes from ``low`` to ``high`` of a document, of which ``spaced`` is what begins at ``start``."""
        at = [0, *(m.start() for m in _CUT.finditer(spaced) if m.start()), len(spaced)]
        out, inside, place = Fragment(), [], start
        for x, y in zip(at, at[1:]):
            unit = spaced[x:y]
            end = place + len(unit.encode())
            if place >= low and end <= high:
                inside.append(unit)
            elif place < high and end > low:
                if inside:
                    out, inside = out.then(self.document("".join(inside))), []
                out = out.then(self.fragment(unit, low - place, high - place))
            place = end
        return out.then(self.document("".join(inside))) if inside else out


def aligner(a: str, b: str) -> Aligner:
    return kept(f"aligner:{a}:{b}", lambda: Aligner(a, b))


_FRAGMENT = "cut boolean, pre_a string, pre_b string, closed string, suf_a string, suf_b string, n_a long, n_b long, n_groups long, pairs binary, times binary, differs boolean"
_FIELDS = [f.split()[0] for f in _FRAGMENT.split(", ")]
_KINDS = [{"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in _FRAGMENT.split(", ")]
_ALIGNED = "row long, ident long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary"


def _aligned(rows: list[tuple[int, int | None, Fragment]]) -> pa.RecordBatch:
    out = []
    for row, ident, f in rows:
        ok = not f.differs and f.n_a > 0
        out.append((row, ident, f.n_a, f.n_b, f.n_groups, f.groups(), f.pairs, f.times) if ok else (row, ident, 0, 0, 0, "", b"", b""))
    kinds = [*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], [f.split()[0] for f in _ALIGNED.split(", ")])


def _read(raw: bytes) -> str | None:
    try:
        return " " + raw.decode()
    except UnicodeDecodeError:
        return None


def _whole_documents(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(a, b)
        for batch in batches:
            # Some texts at a time: groups are longer than the texts.
            for group in vocab.in_groups(zip(*(batch.column(i) for i in range(3))), lambda r: r[2].as_buffer().size):
                texts = [_read(raw.as_py()) for _, _, raw in group]
                found = iter(by.documents([t for t in texts if t not in (None, " ")]))
                fragments = [Fragment() if t in (None, " ") else next(found) for t in texts]
                yield _aligned([(row.as_py(), ident.as_py(), f) for (row, ident, _), f in zip(group, fragments)])

    return run


def _ranges(size: int):
    """Ranges of ``size`` bytes of a space and the text, each with the bytes between the safe places around it."""

    def last_before(full: bytes, at: int) -> int:
        while at > 0 and not _CUT_BYTES.match(full, at):
            at = full.rfind(b" ", 0, at)
        return max(at, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ident, raw in zip(*(batch.column(i) for i in range(3))):
                full = b" " + raw.as_py()
                for k, low in enumerate(range(0, len(full), size)):
                    high = min(low + size, len(full))
                    after = _CUT_BYTES.search(full, high) if high < len(full) else None
                    start, end = last_before(full, low), after.start() if after else len(full)
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(
                        (row.as_py(), ident.as_py(), k, start, low, high, full[start:end]), [*[pa.int64()] * 6, pa.binary()]
                    )], ["row", "ident", "k", "start", "low", "high", "spaced"])

    return run


def _parts(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(a, b)
        for batch in batches:
            for row, ident, k, start, low, high, raw in zip(*(batch.column(i) for i in range(7))):
                spaced = _read(raw.as_py()[1:])
                f = Fragment(differs=True) if spaced is None else by.part(spaced, start.as_py(), low.as_py(), high.as_py())
                yield _fragments([(row.as_py(), ident.as_py(), k.as_py(), f)])

    return run


def _fragments(rows: list[tuple[int, int | None, int, Fragment]]) -> pa.RecordBatch:
    columns = list(zip(*[(row, ident, k, *(getattr(f, n) for n in _FIELDS)) for row, ident, k, f in rows]))
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 3, *_KINDS])], ["row", "ident", "k", *_FIELDS])


def _composed(table: pa.Table) -> tuple[int, int | None, int, Fragment]:
    """One fragment of up to ``FAN`` neighbours."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    whole = Fragment()
    for r in rows:
        whole = whole.then(Fragment(**{n: r[n] for n in _FIELDS}))
    return rows[0]["row"], rows[0]["ident"], rows[0]["k"] // FAN, whole


def _composing(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_fragments([_composed(table)])])


def _finishing(table: pa.Table) -> pa.Table:
    """The last step of the tree: whole documents."""
    row, ident, _, whole = _composed(table)
    return pa.Table.from_batches([_aligned([(row, ident, whole)])])


def align(docs: DataFrame, a: str, b: str, ident: str = "doc_id", text: str = "text", size: int = RANGE) -> DataFrame:
    """``row, ident, n_a, n_b, n_groups, groups, pairs, times`` for every row of ``docs``; ``row`` is a number of its own.

    ``groups`` lists ids as ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the distinct linked ids, A times 32,768 plus B, and ``times`` their
    numbers, as binary arrays of 32 and 64 bits. Null, empty and undecodable texts, and those whose bytes the tokens don't give back, have no
    tokens. Repeated rows are rows like others; an empty table gives none; other columns are not read. A text without a safe place for a
    cut is tokenised whole in each of its ranges.
    """
    length = F.octet_length(F.col(text))
    made = lambda tag: F.monotonically_increasing_id() * 2 + tag
    columns = [F.col(ident).cast("long").alias("ident"), text_bytes(F.col(text)).alias("raw")]
    short = docs.filter(F.coalesce(length, F.lit(0)) < size).select(made(0).alias("row"), *columns)
    whole = arrow_stage(short, _whole_documents(a, b), _ALIGNED)
    long = docs.filter(length >= size).select(made(1).alias("row"), *columns)
    cut = arrow_stage(long, _ranges(size), "row long, ident long, k long, start long, low long, high long, spaced binary")
    level = arrow_stage(cut.repartition("row", "k"), _parts(a, b), f"row long, ident long, k long, {_FRAGMENT}")
    most = docs.agg(F.max(length)).first()[0] or 0
    if most < size:
        return whole
    pieces = -(-(most + 1) // size)
    # One Python stage a task at a time, so that no more task processes than cores hold the vocabularies.
    while pieces > FAN:
        level = level.groupBy("row", F.expr(f"k div {FAN}").alias("_at")).applyInArrow(_composing, level.schema)
        pieces = -(-pieces // FAN)
    return whole.unionByName(level.groupBy("row").applyInArrow(_finishing, _ALIGNED))


def _exploding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs, added up in memory for some millions of links at a time."""
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        pairs, times = _added([*held, (b"", b"")]) if len(held) > 1 else held[0] if held else (b"", b"")
        return pa.record_batch([pa.array(np.frombuffer(pairs, "<u4").astype(np.int64)), pa.array(np.frombuffer(times, "<i8"))], ["pair", "n"])

    for batch in batches:
        for pairs, times in zip(batch.column(0), batch.column(1)):
            held.append((pairs.as_py(), times.as_py()))
            n += len(held[-1][0]) // 4
            if n > 2_000_000:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each pair of ids over all documents, and whether none of its B id has more."""
    counts = arrow_stage(aligned.select("pairs", "times"), _exploding, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "pair-counts")
    highest = counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(highest, F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looking_up(hot, keep: list[str]):
    """What the hot pairs add to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = (np.frombuffer(x, t) for x, t in zip(hot.value, ("<u4", "<i8", "?")))
        for batch in batches:
            n_best, sums = [], []
            for pairs, times in zip(batch.column("pairs"), batch.column("times")):
                own, n = np.frombuffer(pairs.as_py(), "<u4"), np.frombuffer(times.as_py(), "<i8")
                at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
                is_hot = codes[at] == own if len(codes) else np.zeros(len(own), bool)
                at, n = at[is_hot], n[is_hot]
                n_best.append(int(n[best[at]].sum()))
                sums.append(int((n * counts[at]).sum()))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())], [*keep, "hot_best", "hot_sum"])

    return run


def _cold(hot):
    """``row, pair, n`` for the pairs that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(hot.value[0], "<u4")
        for batch in batches:
            rows, found, numbers = [], [], []
            for row, pairs, times in zip(batch.column("row").to_pylist(), batch.column("pairs"), batch.column("times")):
                own, n = np.frombuffer(pairs.as_py(), "<u4"), np.frombuffer(times.as_py(), "<i8")
                at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
                rare = codes[at] != own if len(codes) else np.ones(len(own), bool)
                rows.append(np.full(int(rare.sum()), row))
                found.append(own[rare].astype(np.int64))
                numbers.append(n[rare])
            join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int64())
            yield pa.record_batch([join(rows), join(found), join(numbers)], ["row", "pair", "n"])

    return run


def linked(aligned: DataFrame, hot: int = HOT) -> DataFrame:
    """Written ``aligned`` rows without ``pairs`` and ``times``, with ``n_best`` and ``count_sum``.

    ``n_best``: links whose pair is its B id's most frequent one, ties included; ``count_sum``: the corpus-wide counts of the
    links' pairs, added up. A row without tokens has zeros.
    """
    spark = aligned.sparkSession
    counts = materialize(pair_counts(aligned), "pairs")
    links = counts.agg(F.sum("n")).first()[0] or 0
    # No more than ``hot`` pairs can each have this part of all links.
    enough = F.col("n") >= max(1, -(-links // hot))
    sent = counts.filter(enough).orderBy("pair").toPandas()
    arrays = tuple(sent[c].to_numpy().astype(t).tobytes() for c, t in (("pair", "<u4"), ("n", "<i8"), ("best", "?")))
    broadcast = spark.sparkContext.broadcast(arrays)
    others = [c for c in aligned.columns if c not in ("pairs", "times")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in aligned.schema if f.name in others)
    with_hot = arrow_stage(aligned, _looking_up(broadcast, others), fields + "hot_best long, hot_sum long")
    rare = arrow_stage(aligned.select("row", "pairs", "times"), _cold(broadcast), "row long, pair long, n long")
    cold = rare.join(counts.filter(~enough).withColumnsRenamed({"pair": "_pair", "n": "_n"}), F.col("pair") == F.col("_pair")).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("cold_best"), F.sum(F.col("n") * F.col("_n")).alias("cold_sum")
    )
    total = lambda name: (F.col(f"hot_{name}") + F.coalesce(f"cold_{name}", F.lit(0))).cast("long")
    return with_hot.join(cold.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left").select(*others, total("best").alias("n_best"), total("sum").alias("count_sum"))
