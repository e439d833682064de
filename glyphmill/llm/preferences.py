"""Preference pairs: one shared prompt, two completions, and a mask for each.

Turns of the chosen and the rejected conversation meet by their number. The first number at which they differ ends the
prompt; what follows on either side is a completion. The comparison works on single turns, so it needs no conversation
as a whole; only the rendered example is gathered, and an example is one row. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.rows import let

#: Values of ``part``.
PROMPT, CHOSEN, REJECTED = "prompt", "chosen", "rejected"


@dataclass(frozen=True)
class Template:
    """How a turn is written: ``before`` its role, ``between`` role and text, ``after`` its text; and whose turns are learnt."""

    before: str = "<|"
    between: str = "|>\n"
    after: str = "<|end|>\n"
    learnt: str = "assistant"

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.before), role, F.lit(self.between))


def _turns(conversations: DataFrame, side: str) -> DataFrame:
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.filter("pair_id is not null").select("pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("turn"), said.alias("said"))
    return rows.distinct().withColumn("side", F.lit(side))


def aligned(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """A row for each turn of each pair, ``pair_id, part, turn, said``: shared turns once, as ``prompt``.

    ``said`` is what both or one side have at that number: usually one ``role, text``, several in order if a table has the same
    number more than once with different texts. Copies of a row count once.
    """
    both = _turns(chosen, CHOSEN).union(_turns(rejected, REJECTED))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("said"))))
    # One group is what two conversations say at one number.
    turns = both.groupBy("pair_id", "turn").agg(of(CHOSEN).alias(CHOSEN), of(REJECTED).alias(REJECTED))
    end = turns.groupBy("pair_id").agg(F.min(F.when(F.col(CHOSEN) != F.col(REJECTED), F.col("turn"))).alias("end"))
    cut = turns.join(end, "pair_id")
    shared = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    part = lambda name, said: F.struct(F.lit(name).alias("part"), said.alias("said"))
    parts = F.when(shared, F.array(part(PROMPT, F.col(CHOSEN)))).otherwise(
        F.filter(F.array(part(CHOSEN, F.col(CHOSEN)), part(REJECTED, F.col(REJECTED))), lambda p: F.size(p["said"]) > 0)
    )
    return cut.select("pair_id", "turn", F.explode(parts).alias("p")).select("pair_id", "p.part", "turn", "p.said")


def examples(chosen: DataFrame, rejected: DataFrame, template: Template = Template()) -> DataFrame:
    """A row for each pair: ``prompt``, the completions ``chosen`` and ``rejected``, and the spans of each that are learnt.

    ``chosen`` and ``rejected``: tables of ``pair_id, turn, role, text``; other columns are ignored. Spans are ``start, length`` in
    characters of the completion: the text and the closing mark of every turn of the learnt role. The prompt is never
    learnt. A pair with one side missing has an empty prompt and an empty completion on that side; equal
    conversations are all prompt; null roles and texts are empty, a null turn comes first, rows without ``pair_id`` are left out.
    """
    def turns_of(part: str) -> Column:
        found = F.collect_list(F.when(F.col("part") == part, F.struct("turn", "said")))
        return F.flatten(F.transform(F.sort_array(found), lambda t: t["said"])).alias(part)

    n_prompt = F.count_if(F.col("part") == PROMPT).alias("n_prompt_turns")
    gathered = aligned(chosen, rejected).groupBy("pair_id").agg(turns_of(PROMPT), turns_of(CHOSEN), turns_of(REJECTED), n_prompt)
    written = lambda turn: F.concat(template.head(turn["role"]), turn["text"], F.lit(template.after))
    rendered = lambda part: F.array_join(F.transform(part, written), "")

    def spans(part: Column) -> Column:
        sizes = F.transform(part, lambda t: F.struct(
            F.length(template.head(t["role"])).alias("head"), (F.length(t["text"]) + len(template.after)).alias("body"), (t["role"] == template.learnt).alias("learnt")
        ))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))
        return let(sizes, lambda s: F.aggregate(s, start, lambda a, t: F.struct(
            (a["at"] + t["head"] + t["body"]).alias("at"),
            F.when(t["learnt"], F.concat(a["out"], F.array(F.struct((a["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(a["out"]).alias("out"),
        ), lambda a: a["out"]))

    return gathered.select(
        "pair_id", "n_prompt_turns", rendered(F.col(PROMPT)).alias(PROMPT), rendered(F.col(CHOSEN)).alias(CHOSEN), rendered(F.col(REJECTED)).alias(REJECTED),
        spans(F.col(CHOSEN)).alias("chosen_spans"), spans(F.col(REJECTED)).alias("rejected_spans"),
    )


def with_other_answer(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs made from a table of conversations: each as it is, against itself with its last answer taken from its neighbour.

    Conversations 2k and 2k+1 are neighbours. The rejected side has the turns before the last assistant turn and, in its
    place, the neighbour's last assistant turn, if there is one. Copies of a row count once, and if two answers share the last
    number, the greater text stands for them.
    """
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answers = rows.filter("role = 'assistant' and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    own = answers.select("pair_id", F.col("last.turn").alias("until"))
    other = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("text"))
    before = rows.join(own, "pair_id", "left").filter("until is null or turn is null or turn < until").select("pair_id", "turn", "role", "text")
    swapped = own.join(other, "pair_id").select("pair_id", F.col("until").alias("turn"), F.lit("assistant").alias("role"), "text")
    return rows, before.union(swapped)
