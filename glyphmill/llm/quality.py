"""Quality rules: repetition and length by counting, then the fertility of a public tokenizer within bands per group.

A tokenizer cuts ordinary text of a language into pieces of a steady size. Text that it cuts much finer or
coarser, that it can only spell out in bytes, or whose pieces are few and repeated, is not ordinary text of that
language. Characters per token, byte-fallback share and token entropy are measured on whole texts; the bands lie around
the medians of each group (a language, or any other column), from histograms over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm import vocab
from glyphmill.llm.common import arrow_stage
from glyphmill.scratch import materialize
from glyphmill.worker import kept

_SYMBOLS = "#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]
_MEASURES = ["chars_per_token", "byte_share", "entropy"]
NEW = [*_COUNTS, *_MEASURES, "base_failed", "kept"]


@dataclass(frozen=True)
class Bands:
    """How far from its group's median a text may lie.

    ``spreads`` times the group's quartile range, which counts as at least ``least_range`` (chars per token, on both sides: a
    share of the median; entropy, below: bits; byte share, above). Short texts scatter more, so the band of a text with fewer tokens than the
    group's median widens with the root of their ratio. A group of under ``least_group`` texts that pass the base rules says too little about
    itself and is judged by the bands of all documents.
    """

    spreads: tuple[float, float, float] = (5.0, 1.75, 5.0)
    least_range: tuple[float, float, float] = (0.02, 0.25, 0.05)
    least_group: int = 30


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    pairs = ids[:-1] * len(number) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    hit = np.zeros(len(words), bool)
    for i in range(3):
        hit[i : i + len(twice)] |= twice
    return int(hit.sum())


def _byte_pieces(name: str) -> np.ndarray:
    processor = vocab.pieces(name)
    return np.array([processor.is_byte(i) for i in range(processor.get_piece_size())])


def measure(text: str, processor, is_byte: np.ndarray) -> tuple:
    """Counts and measures of one text, in the order of ``_COUNTS`` and ``_MEASURES``."""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup_lines += line in seen
            seen.add(line)
    in_words = len(text) - (len(raw) - sum(map(len, words)))
    symbols = sum(map(text.count, _SYMBOLS))
    ids = np.array(processor.encode(text), np.int64)
    n = len(ids)
    if n:
        counts = np.bincount(ids)
        p = counts[counts > 0] / n
        fertility = (len(text) / n, float(is_byte[ids].mean()), float(max(0.0, -(p * np.log2(p)).sum())))
    else:
        fertility = (0.0, 0.0, 0.0)
    return (len(words), in_words, symbols, dup_lines, repeat_words(words), n, *fertility)


def _measuring(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, is_byte = vocab.pieces(name), kept(f"byte pieces:{name}", lambda: _byte_pieces(name))
        for batch in batches:
            names = batch.schema.names
            text = batch.column(names.index("_text"))
            rows = [measure(t.as_py().decode("utf-8", "replace"), processor, is_byte) for t in text]
            new = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * len(_COUNTS) + [pa.float64()] * len(_MEASURES)
            others = [n for n in names if n != "_text"]
            yield pa.record_batch(
                [*(batch.column(names.index(n)) for n in others), *(pa.array(c, k) for c, k in zip(new, kinds))], [*others, *_COUNTS, *_MEASURES]
            )

    return run


def measured(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of them) with all counts and measures and ``base_failed``."""
    columns = [c for c in (keep or docs.columns) if c not in NEW]
    given = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop("_text").schema] + [f"{c} long" for c in _COUNTS] + [f"{c} double" for c in _MEASURES])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return arrow_stage(given, _measuring(vocabulary), kinds).withColumn("base_failed", failed)


#: Measures and token counts in whole bins: exact counts, so reruns agree.
_BINS = {
    "c": lambda: F.floor(F.col("chars_per_token") * 100), "h": lambda: F.floor(F.col("entropy") * 50), "b": lambda: F.floor(F.col("byte_share") * 200),
    "n": lambda: F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) * 20),
}


def bands(measures: DataFrame, group: str, least_group: int) -> DataFrame:
    """Quartiles of each group's texts that pass the base rules, and of all texts for small groups.

    A group's histogram has as many bins as a measure has values, which the vocabulary bounds, whatever the number of its texts.
    """
    bins = F.array(*[F.struct(F.lit(m).alias("m"), at().alias("at")) for m, at in _BINS.items()])
    # A group whose texts all fail the base rules has no cell, but it has a row here.
    cells = measures.select(F.col(group).alias("group"), F.explode_outer(F.when(~F.col("base_failed"), bins)).alias("b"))
    counts = materialize(cells.groupBy("group", "b.m", "b.at").agg(F.count("b").alias("n")), "bins")

    def quartiles(of: DataFrame, *keys: str) -> DataFrame:
        whole = W.partitionBy(*keys, "m")
        summed = of.withColumns({"up": F.sum("n").over(whole.orderBy("at")), "all": F.sum("n").over(whole)})
        quartile = lambda m, k: F.min(F.when((F.col("m") == m) & (4 * F.col("up") >= k * F.col("all")), F.col("at")))
        return summed.groupBy(*keys).agg(
            F.max("all").alias("texts"), F.struct(
                *[(quartile(m, k) / d).alias(f"{m}{k}") for m, d in (("c", 100), ("h", 50), ("b", 200)) for k in (1, 2, 3)], F.pow(2, quartile("n", 2) / 20).alias("tokens")
            ).alias("band"),
        )

    found = quartiles(counts, "group")
    # One row of ten numbers, whatever the table.
    wide = quartiles(counts.filter("m is not null").groupBy("m", "at").agg(F.sum("n").alias("n"))).first()["band"]
    of_all = F.struct(*[F.lit(wide[c] if wide else None).cast("double").alias(c) for c in found.schema["band"].dataType.names])
    return found.select("group", F.when(F.col("texts") >= least_group, F.col("band")).otherwise(of_all).alias("band"))


def judged(measures: DataFrame, group: str, rules: Bands = Bands()) -> DataFrame:
    """Adds ``kept`` to written measures: false where a base rule failed or a measure leaves its band."""
    limits = materialize(bands(measures, group, rules.least_group), "bands").select(F.col("group").alias("_group"), F.col("band").alias("_band"))
    band = lambda c: F.col(f"_band.{c}")
    wide = F.greatest(F.lit(1.0), F.sqrt(band("tokens") / F.greatest("n_tokens", F.lit(1))))
    half_c = rules.spreads[0] * wide * F.greatest(band("c3") - band("c1"), rules.least_range[0] * band("c2"))
    half_h = rules.spreads[1] * wide * F.greatest(band("h3") - band("h1"), F.lit(rules.least_range[1]))
    half_b = rules.spreads[2] * wide * F.greatest(band("b3") - band("b1"), F.lit(rules.least_range[2]))
    fine = (F.abs(F.col("chars_per_token") - band("c2")) <= half_c) & (F.col("entropy") >= band("h2") - half_h) & (F.col("byte_share") <= band("b2") + half_b)
    joined = measures.join(limits, F.col(group).eqNullSafe(F.col("_group")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(False))).drop("_group", "_band")


def judge(docs: DataFrame, vocabulary: str, group: str = "lang", rules: Bands = Bands(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` and ``group``) with counts, measures, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules; a null group is a group of its own; repeated rows
    are judged alike; an empty table gives none; columns of ``docs`` with the new names are replaced.
    """
    columns = list(dict.fromkeys([*(keep or docs.columns), group]))
    return judged(materialize(measured(docs, vocabulary, text, columns), "quality"), group, rules)


def keep(docs: DataFrame, vocabulary: str, group: str = "lang", rules: Bands = Bands(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were.

    Texts are written once beside their measures, so that none is measured a second time when the bands are known.
    """
    plain = docs.select([F.col(c).alias(f"_in_{c}") for c in docs.columns])
    judged_ = judge(plain, vocabulary, f"_in_{group}", rules, f"_in_{text}")
    return judged_.filter("kept").select([F.col(f"_in_{c}").alias(c) for c in docs.columns])
