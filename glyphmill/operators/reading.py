"""From file bytes to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T

# Outcomes of a unit of work.
OK, SKIPPED, FAILED = "ok", "skipped", "failed"


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Replace the bytes by ``text``; an empty or undecodable file gets an ``error`` instead.

    Decoding is a guarded cast: ``decode`` would raise on bad bytes and end the job.
    """
    raw: Column = F.col(content).cast("string")
    error = F.when(F.length(F.col(content)) == 0, "file is empty").when(
        ~F.is_valid_utf8(raw), "file is not valid UTF-8"
    )
    if "error" in files.columns:
        error = F.coalesce(F.col("error"), error)
    return (
        files.withColumn("error", error)
        .withColumn("text", F.when(F.col("error").isNull(), T.normalize_newlines(raw)))
        .drop(content)
    )


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("error").isNull(), OK).otherwise(FAILED))
