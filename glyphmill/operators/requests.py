"""Turning pieces into what a provider is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import fill_template

MESSAGE = "struct<role:string,content:string>"
HISTORY = f"array<{MESSAGE}>"

# Wording of a flat prompt around the system rules.
RULES_PREFIX = "Remember these rules:\n"
RULES_REPLY = "\nCertainly, I will remember and follow these rules.\n"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render_prompt(df: DataFrame, prompts: dict[str, str | None], kind: str = "kind", code: str = "code") -> DataFrame:
    """Add ``user``: the prompt of the row's kind with the code filled in.

    A kind without a prompt makes the row an error and leaves ``user`` null.
    """
    template = F.lit(None).cast("string")
    for name, value in prompts.items():
        if value:
            template = F.when(F.col(kind) == name, F.lit(value)).otherwise(template)
    missing = F.when(
        F.col(kind).isNotNull() & template.isNull(),
        F.concat(F.lit("prompt '"), F.col(kind), F.lit("' is not defined")),
    )
    earlier = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return df.withColumn("user", fill_template(template, CODE=F.col(code))).withColumn(
        "error", F.coalesce(earlier, missing)
    )


def example_messages(examples: Column, user_request: str, assistant_response: str) -> Column:
    """Known pairs (array of ``source``/``target``) as alternating user and assistant messages, in order."""
    return F.flatten(
        F.transform(
            examples,
            lambda e: F.array(
                message("user", fill_template(F.lit(user_request), SOURCE=e["source"], TARGET=e["target"])),
                message("assistant", F.lit(assistant_response)),
            ),
        )
    )


def _or_none(history: Column | None) -> Column:
    empty = F.array().cast(HISTORY)
    return empty if history is None else F.coalesce(history, empty)


def assemble_messages(user: Column, system: Column | None = None, history: Column | None = None) -> Column:
    """Chat form: system rules if there are any, the history in order, then the question."""
    first = F.array().cast(HISTORY)
    if system is not None:
        first = F.when(F.length(system) > 0, F.array(message("system", system)).cast(HISTORY)).otherwise(first)
    return F.concat(first, _or_none(history), F.array(message("user", user)).cast(HISTORY))


def flatten_messages(
    prompt_template: str, user: Column, system: Column | None = None, history: Column | None = None
) -> Column:
    """One flat prompt: user turns in the model's template, other turns inline."""

    def wrap(*parts) -> Column:
        return fill_template(F.lit(prompt_template), PROMPT=F.concat(*parts))

    nl = F.lit("\n")
    rules = F.lit("")
    if system is not None:
        spoken = F.concat(wrap(F.lit(RULES_PREFIX), system, nl), F.lit(RULES_REPLY))
        rules = F.when(F.length(system) > 0, spoken).otherwise(rules)
    turns = F.transform(
        _or_none(history),
        lambda m: F.when(m["role"] == "user", wrap(nl, m["content"], nl)).otherwise(F.concat(nl, m["content"], nl)),
    )
    return F.concat(rules, F.array_join(turns, ""), wrap(nl, user, nl))
