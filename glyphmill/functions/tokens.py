"""Token counters: how large a text is in the model's own units."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.scratch import ship_package
from glyphmill.worker import kept, key_of


class CharCounter:
    """Characters. Additive, so packing never leaves the JVM."""

    additive = True

    def count(self, c: Column) -> Column:
        return F.length(c).cast("long")


# The kinds of characters whose runs count as one token each.
_KINDS = ["[ \\t\\n\\r]", "[0-9A-Za-z]", "[^ \\t\\n\\r0-9A-Za-z]"]


class RunCounter:
    """Runs of white space, of letters and digits, and of anything else: a rough count of words without a vocabulary.

    Counts don't add up, as a run that ends one text and one that begins the next become one. A summary, ``n`` and the kinds at both
    ends (0 for none), says what joining makes of two texts, so batches are packed without Python.
    """

    additive = False

    def count(self, c: Column) -> Column:
        return F.regexp_count(c, F.lit("|".join(kind + "+" for kind in _KINDS))).cast("long")

    def summary(self, c: Column) -> Column:
        def kind(char: Column) -> Column:
            out = F.lit(0)
            for i, pattern in enumerate(_KINDS):
                out = F.when(char.rlike(pattern), i + 1).otherwise(out)
            return out

        return F.struct(self.count(c).alias("n"), kind(F.left(c, F.lit(1))).alias("head"), kind(F.right(c, F.lit(1))).alias("tail"))

    def joined(self, a: Column, b: Column) -> Column:
        """The summary of one text followed by another."""
        merged = ((a["tail"] == b["head"]) & (b["head"] > 0)).cast("long")
        return F.struct(
            (a["n"] + b["n"] - merged).alias("n"),
            F.when(a["head"] > 0, a["head"]).otherwise(b["head"]).alias("head"),
            F.when(b["tail"] > 0, b["tail"]).otherwise(a["tail"]).alias("tail"),
        )


class EncodedCounter:
    """Tokens of an encoder loaded once per Python worker, fed in Arrow batches."""

    additive = False

    def load(self):
        """Return ``str -> int``; called once per task process."""
        raise NotImplementedError

    def count(self, c: Column) -> Column:
        ship_package()
        counter, key = self, key_of(self)

        @F.pandas_udf("long")
        def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            size = kept(key, counter.load)
            for texts in batches:
                yield texts.map(size, na_action="ignore").astype("Int64")

        return n_tokens(c)


class TiktokenCounter(EncodedCounter):
    """Byte-pair encoding of a named hosted model (needs the vocabulary on the workers)."""

    def __init__(self, model: str):
        self.model = model

    def load(self):
        import tiktoken

        encoding = tiktoken.encoding_for_model(self.model)
        return lambda text: len(encoding.encode(text))


class TokenizerFileCounter(EncodedCounter):
    """Tokens of a ``tokenizer.json`` that every worker can read."""

    def __init__(self, path: str, special_tokens: bool = False):
        self.path = path
        self.special_tokens = special_tokens

    def load(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        return lambda text: len(tokenizer.encode(text, add_special_tokens=self.special_tokens).ids)
