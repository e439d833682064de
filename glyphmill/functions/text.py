"""Text rules as native Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.rows import fold, let

# The characters Python's str.strip() removes, the breaks
# str.splitlines() knows, the fence, and the text used when a reply has no parts.
PY_WS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FENCE = "```"
NO_IMPLEMENTATION = "SEE HEADER FOR FULL RESPONSE"
TAB_WIDTH_SPACES = "    "

# Java looks up a class of single characters below 256 in a table; ranges and higher characters make it a chain of calls.
_RARE_BREAK = "[\r\x0b\x0c\x1c\x1d\x1e\x85]"
_WIDE_BREAKS = "\u2028\u2029"
# A run of PY_WS without the newline, for line-wise patterns; blanks and tabs, which are most of it, are passed by table.
_INLINE_WS = "[ \t]*+[" + PY_WS.replace("\n", "") + "]*+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(PY_WS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(PY_WS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(PY_WS))


def normalize_newlines(c: Column) -> Column:
    """Universal newlines: CRLF and lone CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def directives_to_comments(c: Column) -> Column:
    """Prefix every preprocessor line with ``// `` and re-terminate the last line."""
    marked = F.regexp_replace(c, f"(?md)^({_INLINE_WS}#)", "// $1")
    return F.concat(F.when(F.contains(c, F.lit("#")), marked).otherwise(c), F.lit("\n"))


def convert_indent(c: Column, tabs_to_spaces: bool = False, spaces_to_tabs: bool = False) -> Column:
    """Tabs to four spaces first, then four spaces to a tab; both may apply."""
    if tabs_to_spaces:
        c = F.replace(c, F.lit("\t"), F.lit(TAB_WIDTH_SPACES))
    if spaces_to_tabs:
        c = F.replace(c, F.lit(TAB_WIDTH_SPACES), F.lit("\t"))
    return c


def fill_template(template: Column, **values: Column) -> Column:
    """Replace each ``${KEY}`` literally, in argument order.

    An earlier value that contains a later placeholder is itself rewritten. Uses
    literals, never SQL text: Spark's variable substitution would eat ``${...}``.
    """
    for key, value in values.items():
        template = F.replace(template, F.lit("${" + key + "}"), value)
    return template


def first_code_block(reply: Column, fence: str = FENCE) -> Column:
    """Text of the first fenced block, or the whole reply; stripped at both ends."""
    mark = re.escape(fence)
    pattern = f"(?s){mark}[^\n]*\n(.*?){mark}"
    # rlike tells "no block" from "empty block", which regexp_extract cannot.
    found = F.contains(reply, F.lit(fence)) & reply.rlike(pattern)
    return strip(F.when(found, F.regexp_extract(reply, pattern, 1)).otherwise(reply))


def one_break(c: Column) -> Column:
    """Every line break that ``str.splitlines`` knows as a newline."""
    rare = c.rlike(_RARE_BREAK)
    for wide in _WIDE_BREAKS:
        rare = rare | F.contains(c, F.lit(wide))
    return F.when(rare, F.regexp_replace(c, LINE_BREAK, "\n")).otherwise(c)


def header_and_implementation(
    reply: Column, header_ext: str = ".h", implementation_ext: str = ".cpp", fence: str = FENCE
) -> Column:
    """Split a reply into ``struct<header, implementation>``.

    Only marker lines change what follows belongs to: fences, and comments that end in a
    file extension. One pattern finds the markers and cuts the reply between them; a fold
    over the markers, which are few, gives each stretch its part (``h``, ``i`` or none).
    Once a comment has named a part, fences no longer open or close anything.
    """
    named_line = f"//[^\n]*(?:{re.escape(header_ext)}|{re.escape(implementation_ext)}){_INLINE_WS}"
    marker = f"(?md)^{_INLINE_WS}(?:{re.escape(fence)}[^\n]*+|{named_line})(?:\n|\\z)"

    def labels(text: Column, stretches: Column) -> Column:
        """For each marker, the part that the stretch after it belongs to."""

        def tag(line: Column) -> Column:
            bare = strip(line)
            return F.when(bare.startswith(fence), "fence").when(bare.endswith(header_ext), "h").otherwise("i")

        markers = F.transform(F.regexp_extract_all(text, F.lit(marker), F.lit(0)), tag)
        zero = F.struct(
            F.lit("").alias("part"), F.lit(False).alias("named"), F.lit(False).alias("headed"),
            F.array().cast("array<string>").alias("out"),
        )

        def step(s: Column, tag: Column, at: Column) -> Column:
            opened = F.when(s["part"] != "", "").when(s["headed"], "i").otherwise("h")
            part = F.when(tag != "fence", tag).when(s["named"], s["part"]).otherwise(opened)
            filled = (part == "h") & (F.get(stretches, at + 1) != "")
            return F.struct(
                part.alias("part"), (s["named"] | (tag != "fence")).alias("named"),
                (s["headed"] | filled).alias("headed"), F.concat(s["out"], F.array(part)).alias("out"),
            )

        return fold(markers, zero, ["part", "named", "headed"], step)["out"]

    def parts(stretches: Column, labels: Column) -> Column:
        def joined(part: str) -> Column:
            own = F.transform(labels, lambda label, i: F.when(label == part, F.get(stretches, i + 1)))
            return F.array_join(own, "")

        def result(found: Column) -> Column:
            nothing = (found["h"] == "") & (found["i"] == "")
            return F.struct(
                F.when(nothing, strip(reply)).otherwise(strip(found["h"])).alias("header"),
                F.when(nothing, F.lit(NO_IMPLEMENTATION)).otherwise(strip(found["i"])).alias("implementation"),
            )

        return let(F.struct(joined("h").alias("h"), joined("i").alias("i")), result)

    def split(text: Column) -> Column:
        return let(
            F.split(text, marker), lambda stretches: let(labels(text, stretches), lambda found: parts(stretches, found))
        )

    return let(one_break(reply), split)


def camel_to_snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"))


def snake_to_camel(c: Column) -> Column:
    words = F.split(c, "_")
    rest = F.transform(
        F.slice(words, F.lit(2), F.size(words)),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))),
    )
    return F.concat(F.get(words, F.lit(0)), F.array_join(rest, ""))
