"""Greedy packing of ordered units into batches that fit a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.rows import fold, let, take
from glyphmill.scratch import ship_package
from glyphmill.worker import kept, key_of

# Fixed value: what stands between two units of a batch.
SEPARATOR = "\n\n"

_RANGE = "struct<first:int,n:int>"


def pack_by_chars(units: Column, limit: int) -> Column:
    """Batches of ``array<string>`` units under ``limit`` characters, as ``array<string>``.

    Batch by batch, a unit joins while the batch stays strictly below the limit and
    otherwise starts the next one unchecked. The first batch grows from nothing, so it
    leads with the separator, and it is empty if the very first unit does not fit.

    The fold carries lengths and index ranges only; texts are cut once at the end.
    """
    zero = F.struct(
        F.lit(0).alias("first"),
        F.lit(0).alias("n"),
        F.lit(0).cast("long").alias("size"),
        F.array().cast(f"array<{_RANGE}>").alias("out"),
    )

    def range_of(s: Column) -> Column:
        return F.array(F.struct(s["first"].alias("first"), s["n"].alias("n")))

    def step(s: Column, unit: Column, _: Column) -> Column:
        grown = s["size"] + len(SEPARATOR) + F.length(unit)
        joins = F.struct(
            s["first"].alias("first"), (s["n"] + 1).alias("n"), grown.alias("size"), s["out"].alias("out")
        )
        starts = F.struct(
            (s["first"] + s["n"]).alias("first"),
            F.lit(1).alias("n"),
            F.length(unit).cast("long").alias("size"),
            F.concat(s["out"], range_of(s)).alias("out"),
        )
        return F.when(grown < limit, joins).otherwise(starts)

    def finish(s: Column) -> Column:
        return let(s, lambda s: F.when(s["size"] > 0, F.concat(s["out"], range_of(s))).otherwise(s["out"]))

    def batches(units: Column) -> Column:
        def text(r: Column, ix: Column) -> Column:
            body = F.array_join(take(units, r["first"], r["n"]), SEPARATOR)
            return F.when((ix == 0) & (r["n"] > 0), F.concat(F.lit(SEPARATOR), body)).otherwise(body)

        return F.transform(finish(fold(units, zero, ["first", "n", "size"], step)), text)

    return let(units, batches)


def pack_by_summary(units: Column, counter, limit: int) -> Column:
    """The same packing for counters whose ``summary`` of a text says what joining adds to it or merges."""
    kind = "struct<n:bigint,head:int,tail:int>"
    nothing = counter.summary(F.lit("")).cast(kind)
    zero = F.struct(
        F.lit(0).alias("first"), F.lit(0).alias("n"), nothing.alias("size"), F.array().cast(f"array<{_RANGE}>").alias("out")
    )
    between = counter.summary(F.lit(SEPARATOR))

    def range_of(s: Column) -> Column:
        return F.array(F.struct(s["first"].alias("first"), s["n"].alias("n")))

    def step(s: Column, unit: Column, _: Column) -> Column:
        def chosen(grown: Column) -> Column:
            joins = F.struct(s["first"].alias("first"), (s["n"] + 1).alias("n"), grown.alias("size"), s["out"].alias("out"))
            starts = F.struct(
                (s["first"] + s["n"]).alias("first"), F.lit(1).alias("n"), unit.alias("size"), F.concat(s["out"], range_of(s)).alias("out")
            )
            return F.when(grown["n"] < limit, joins).otherwise(starts)

        after = lambda held: counter.joined(held, unit).cast(kind)
        return let(let(counter.joined(s["size"], between).cast(kind), after), chosen)

    def batches(units: Column) -> Column:
        def text(r: Column, ix: Column) -> Column:
            body = F.array_join(take(units, r["first"], r["n"]), SEPARATOR)
            return F.when((ix == 0) & (r["n"] > 0), F.concat(F.lit(SEPARATOR), body)).otherwise(body)

        sized = F.transform(units, lambda u: counter.summary(u).cast(kind))
        ranges = let(
            fold(sized, zero, ["first", "n", "size"], step),
            lambda s: F.when(s["size"]["n"] > 0, F.concat(s["out"], range_of(s))).otherwise(s["out"]),
        )
        return F.transform(ranges, text)

    return let(units, batches)


def counted_ranges(texts: list[str], count, limit: int) -> list[tuple[int, int]]:
    """Index ranges of the batches of ``texts`` for any counter that does not shrink as text is added.

    Every unit is counted once. Sums of those counts say where a batch should end; whole batches are counted only around
    there, to correct for what joining adds or merges. A range that starts at 0 leads with the separator and may be
    empty; any other takes its first unit unchecked.
    """
    between = count(SEPARATOR)
    reach = np.cumsum([count(t) + between for t in texts])
    out: list[tuple[int, int]] = []
    start = least = 0
    while start < len(texts):

        def fits(stop: int, start=start) -> bool:
            lead = SEPARATOR if not out else ""
            return count(lead + SEPARATOR.join(texts[start:stop])) < limit

        spent = reach[start - 1] if start else 0
        stop = max(least, int(np.searchsorted(reach, spent + limit)))
        while stop > least and not fits(stop):
            stop -= 1
        while stop < len(texts) and fits(stop + 1):
            stop += 1
        out.append((start, stop))
        start, least = stop, stop + 1
    return out


def pack_by_counter(units: Column, counter, limit: int) -> Column:
    """The same packing for counters whose counts do not add up."""

    ship_package()
    key = key_of(counter)

    @F.pandas_udf("array<string>")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = kept(key, counter.load)

        def rendered(texts):
            if texts is None:
                return None
            texts = list(texts)
            ranges = counted_ranges(texts, count, limit)
            made = [SEPARATOR.join(texts[a:b]) for a, b in ranges]
            if made and ranges[0][1]:
                made[0] = SEPARATOR + made[0]
            return made if not made or made[-1] else made[:-1]

        for column in batches:
            yield column.map(rendered)

    return packed(units)


def pack(units: Column, counter, limit: int | None, drop_empty: bool = False) -> Column:
    """Pack with any counter; without a limit everything goes into one batch."""
    if limit is None:
        limit = 1 << 62
    if counter.additive:
        batches = pack_by_chars(units, limit)
    elif hasattr(counter, "joined"):
        batches = pack_by_summary(units, counter, limit)
    else:
        batches = pack_by_counter(units, counter, limit)
    return F.filter(batches, lambda b: b != "") if drop_empty else batches
