"""Sharding along a Hilbert curve, so that shards are narrow in several metadata columns at once.

Each dimension is quantised to a few bits, the codes are joined to one index on the curve, rows are sorted by it and
cut into runs. A run is a compact box in all dimensions, so readers that filter on any of them skip most files.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.rows import let
from glyphmill.llm.common import numbered

#: Bits that each dimension keeps.
BITS = 6


def size_code(size: Column, bits: int = BITS) -> Column:
    """Two steps per doubling of a non-negative number: monotone, without floating point, null as 0."""
    binary = F.bin(F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long"))
    code = 2 * (F.length(binary) - 1) + F.substring(binary, 2, 1).eqNullSafe("1").cast("int")
    return F.least(code, F.lit((1 << bits) - 1)).cast("int")


def value_codes(docs: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """``value, code`` for the distinct values of a column in order, nulls first, spread evenly over the codes."""
    values = numbered(docs.select(F.col(column).alias("value")).distinct(), ["value"], "hilbert-values")
    n = values.count()
    code = F.expr(f"(rank * {1 << bits}) div {n}") if n > 1 << bits else F.col("rank")
    return values.select("value", code.cast("int").alias("code"))


def curve_index(codes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve through ``len(codes)`` dimensions of ``bits`` bits.

    One fold over the bit levels, from the highest. The state holds the orientation of the current cell (its entry
    corner and its direction); three small arrays, worked out here, hold the Gray code of a cell and how cells turn.
    """
    n = len(codes)
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    rank = [gray.index(i) for i in range(1 << n)]
    trailing = [((~i & (i + 1)).bit_length() - 1) for i in range(1 << n)]  # ones at the low end
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(1 << n)]
    turn = [0 if i == 0 else trailing[i - 1 if i % 2 == 0 else i] % n for i in range(1 << n)]

    def table(values: list[int], at: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), at)

    def shifted(way: str, x: Column, by: Column) -> Column:
        return F.call_function(way, x, by)

    def left(x: Column, by: Column) -> Column:
        return shifted("shiftleft", x, by).bitwiseOR(shifted("shiftright", x, F.lit(n) - by)).bitwiseAND(F.lit(full))

    def right(x: Column, by: Column) -> Column:
        return shifted("shiftright", x, by).bitwiseOR(shifted("shiftleft", x, F.lit(n) - by)).bitwiseAND(F.lit(full))

    def step(state: Column, digit: Column) -> Column:
        spin = state["d"] + 1
        return let(
            F.struct(table(rank, right(digit.bitwiseXOR(state["e"]), spin)).alias("w"), spin.alias("spin")),
            lambda v: F.struct(
                (state["h"] * (1 << n) + v["w"]).cast("long").alias("h"),
                state["e"].bitwiseXOR(left(table(entry, v["w"]), v["spin"])).cast("int").alias("e"),
                F.pmod(state["d"] + table(turn, v["w"]) + 1, F.lit(n)).cast("int").alias("d"),
            ),
        )

    def digit(level: int) -> Column:
        parts = [F.shiftleft(F.shiftright(c, level).bitwiseAND(F.lit(1)), i) for i, c in enumerate(codes)]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return out.cast("int")

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.array(*[digit(i) for i in reversed(range(bits))]), start, step, lambda s: s["h"])


def places(docs: DataFrame, values: list[str], sizes: list[str], shards: int, ident: str = "doc_id", bits: int = BITS) -> DataFrame:
    """All rows of ``docs`` with ``curve_index``, ``shard`` and ``slot``, sorted along the curve in a scratch table.

    ``values`` are dimensions coded by the order of their distinct values, ``sizes`` are numbers coded by magnitude.
    Shards are runs of the curve whose row counts differ by one at most; ``slot`` counts from 0 in each. Ties are
    ordered by ``ident``. Nulls get the lowest code, repeated rows stay separate, and with fewer rows than shards
    some shards are empty; an empty table gives none; columns of ``docs`` with the names of the three new ones are replaced. Meant for narrow
    rows, since all their columns are sorted.
    """
    docs = docs.drop("curve_index", "shard", "slot")
    coded = docs
    for i, c in enumerate(values):
        codes = value_codes(docs, c, bits).select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
        coded = coded.join(codes, F.col(c).eqNullSafe(F.col(f"_value{i}"))).drop(f"_value{i}")
    codes = [F.col(f"_code{i}") for i in range(len(values))] + [size_code(F.col(c), bits) for c in sizes]
    laid = coded.withColumn("curve_index", curve_index(codes, bits)).drop(*[f"_code{i}" for i in range(len(values))])
    ranked = numbered(laid, ["curve_index", ident], "hilbert", rank="_rank")
    total = max(1, ranked.count())
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    cut = ranked.withColumn("shard", F.expr(f"(_rank * {shards}) div {total}").cast("int"))
    return cut.withColumn("slot", (F.col("_rank") - first).cast("long")).drop("_rank")


def shard(docs: DataFrame, values: list[str], sizes: list[str | Column], shards: int, ident: str = "doc_id", bits: int = BITS) -> DataFrame:
    """All rows of ``docs`` with ``curve_index``, ``shard`` and ``slot``, as ``places`` gives them; ``sizes`` may be expressions.

    Only a row's number, id and dimensions are sorted; the rows themselves are moved once, by their number, to meet their place, so
    partitions are even in bytes whatever their lengths. ``docs`` must be a table or another scan: it is read twice, and rows are told apart by where
    they stand in it. ``write_shards`` lays them out by shard.
    """
    docs = docs.drop("curve_index", "shard", "slot")
    row = F.monotonically_increasing_id()
    dimensions = [F.col(c).alias(f"v{i}") for i, c in enumerate(values)] + [(F.col(c) if isinstance(c, str) else c).alias(f"s{i}") for i, c in enumerate(sizes)]
    narrow = docs.select(row.alias("row"), F.col(ident).alias("ident"), *dimensions)
    found = places(narrow, [f"v{i}" for i in range(len(values))], [f"s{i}" for i in range(len(sizes))], shards, "ident", bits)
    # Named apart from whatever columns the rows have, and merged at any size.
    placed = found.select(F.col("row").alias("_place_row"), F.struct("curve_index", "shard", "slot").alias("_place"))
    joined = docs.withColumn("_docs_row", row).join(placed.hint("merge"), F.col("_docs_row") == F.col("_place_row"))
    place = placed["_place"]
    return joined.select(*[docs[c] for c in docs.columns], *[place[c].alias(c) for c in ("curve_index", "shard", "slot")])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in order of the curve, for readers that prune by folder and by row-group statistics."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
