"""Cutting texts into pieces a model can take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import csharp
from glyphmill.functions.packing import pack

# Kinds of piece, and the order in which a file's pieces are asked for.
FULL, CLASS_ONLY, METHODS_ONLY = "full", "class_only", "methods_only"


def segment(df: DataFrame, text: str = "text", where: Column | None = None) -> DataFrame:
    """Add ``units`` (array of method texts) and ``skeleton``; null where ``where`` is false.

    Each stage is a projection of its own, so that what is read twice is computed once.
    """

    def only(c: Column) -> Column:
        return c if where is None else F.when(where, c)

    return (
        df.withColumn("_parts", only(csharp.pieces(F.col(text))))
        .withColumn("_spans", csharp.method_spans(F.col("_parts")))
        .withColumn("_cut", csharp.cut_spans(F.col("_spans")))
        .withColumn("units", csharp.method_units(F.col("_parts"), F.col("_spans")))
        .withColumn("skeleton", csharp.class_skeleton(F.col("_parts"), F.col("_cut")))
        .drop("_parts", "_spans", "_cut")
    )


def fits(n_tokens: Column, limit: int | None) -> Column:
    """Whether a text goes out whole: strictly below the limit, or no limit at all."""
    return F.lit(True) if limit is None else n_tokens < limit


def plan_pieces(
    df: DataFrame, counter, limit: int | None, text: str = "text", drop_empty: bool = False
) -> DataFrame:
    """One row per piece to translate: ``kind``, ``piece_ix`` and ``code`` replace the text.

    A file goes out whole or as skeleton plus batches. Both ways leave from one pass
    over the corpus; rows with an ``error`` yield no pieces but stay as one row.
    """
    piece = "array<struct<kind:string,piece_ix:int,code:string>>"
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    if limit is None:
        df = df.withColumn("_whole", F.col("error").isNull())
    else:
        df = df.withColumn("_whole", fits(counter.count(F.col(text)), limit))
    cut = F.col("error").isNull() & ~F.col("_whole")
    df = segment(df, text, where=cut)
    df = df.withColumn("_batches", F.when(cut, pack(F.col("units"), counter, limit, drop_empty)))

    def entry(kind: str, ix: Column, code: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), ix.cast("int").alias("piece_ix"), code.alias("code"))

    batches = F.transform("_batches", lambda b, i: entry(METHODS_ONLY, i + 1, b))
    pieces = (
        F.when(F.col("error").isNotNull(), F.array().cast(piece))
        .when(F.col("_whole"), F.array(entry(FULL, F.lit(0), F.col(text))).cast(piece))
        .otherwise(F.concat(F.array(entry(CLASS_ONLY, F.lit(0), F.col("skeleton"))).cast(piece), batches.cast(piece)))
    )
    keep = [c for c in df.columns if c not in (text, "_whole", "_batches", "units", "skeleton")]
    return df.select(*keep, F.inline_outer(pieces))
