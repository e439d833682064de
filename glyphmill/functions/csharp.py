"""Cutting C# sources into method units and the class skeleton around them.

No grammar and no shuffle: one regular expression lexes a text into pieces that
end at ``{``, ``}`` or ``;`` (comments, strings and directives are swallowed whole,
so their braces do not count), and one ordered fold over the pieces of a row keeps
the stack of open blocks. A file is one row, so its pieces never leave the row.

A declaration may span pieces: what ends within its brackets or parentheses, such as the
braces of an attribute's array, ends nothing. Of the branches of one ``#if`` that
open different numbers of blocks, only the first one counts. Nesting has no limit: groups are
taken out of a declaration from the inside until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.rows import fold, let, take

# Lexical elements. Quantifiers over alternations are possessive: Java matches those
# in a loop, while the backtracking forms recurse and overflow on long texts.
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_STRING = (
    r'(?:\$@|@\$|@)"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
    r'|\$*+("{3,})(?s:.*?)(?:\1|\z)'
    # An interpolated string may have strings in its holes.
    r'|\$"(?:[^"\\\n{]++|\\.|\{\{|\{(?:[^{}"\n]++|"(?:[^"\\\n]++|\\.)*+")*+\}|\{)*+(?:"|(?=\n)|\z)'
    r'|\$*+"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+(?:"|(?=\n)|\z)'
)
_CHAR = r"'(?:\\(?:x[0-9a-fA-F]{1,4}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[^\n])|[^'\\\n])'"
_DIRECTIVE = r"#[^\n]*+"
# The look-ahead only makes the many positions that start nothing cheap.
_OPAQUE = f"""(?=[/"'@$#])(?:{_COMMENT}|{_STRING}|{_CHAR}|{_DIRECTIVE})"""
_PIECE = f"""(?:[^{{}};/"'@$#]++|{_OPAQUE}|[/"'@$])*+(?:[{{}};]|\\z)"""
_LEAD = rf"^(?:\s++|{_COMMENT}|{_DIRECTIVE})*+"

# Directives that choose between branches, also where they have been made comments.
_BRANCH = r"(?m)^[ \t]*+(?://[ \t]*+)?#[ \t]*+(if|elif|else|endif)\b"

# Declarations, read off a text whose comments and strings are blanked and whose groups are
# folded: round ones and square ones to one character each, those of braces and angles to none.
_ROUND, _SQUARE = "\u27ee", "\u27e6"
_FOLDS = ((r"\([^()\[\]{}]*+\)", _ROUND), (r"\[[^()\[\]{}]*+\]", _SQUARE), (r"\{[^()\[\]{}]*+\}", ""))
_ANGLES = r"<[^<>;=]*+>"
_ATTRIBUTES = rf"(?:{_SQUARE}\s*+)*+"
_MODIFIERS = (
    r"(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern"
    r"|unsafe|new|partial|readonly|ref|volatile|required|file)\s++)*+"
)
# Letters, digits, joiners and marks of any script, as identifiers have them; \u escapes stand for such.
_LETTER = r"\p{L}\p{Nl}\p{Nd}\p{Pc}\p{Mn}\p{Mc}\p{Cf}\\@"
_TYPE = rf"(?:[{_LETTER}.:]++|{_ROUND})(?:\s*+(?:\?|\*|{_SQUARE}))*+"
_NOT_A_TYPE = (
    r"(?!(?:class|struct|interface|record|enum|namespace|delegate|event|using|return|throw|await|yield"
    r"|else|case|goto|implicit|explicit|operator)\b)"
)
_NAME = rf"(?!operator\b|this\b)(?:[{_LETTER}]++\.)*+[{_LETTER}]++"
_METHOD = rf"^\s*+{_ATTRIBUTES}{_MODIFIERS}{_NOT_A_TYPE}{_TYPE}\s++{_NAME}\s*+{_ROUND}"
_CLASS = rf"^\s*+{_ATTRIBUTES}{_MODIFIERS}class\b"
_OTHER_TYPE = rf"^\s*+{_ATTRIBUTES}{_MODIFIERS}(?:struct|interface|record|enum)\b"
_NAMESPACE = r"^\s*+namespace\b"

# Kinds of open block on the stack: namespace, class, other type, anything else. Kinds of
# piece are these, a method with a body of statements or of one expression, and the rest.
_NS, _CLS, _TYP, _BLK = "n", "c", "t", "b"
_BODY, _ARROW, _PLAIN = "m", "a", ""

SPAN = "struct<first:int,last:int,kept:boolean>"


def pieces(text: Column) -> Column:
    """The text as ``array<string>``; concatenated they give ``text`` plus one newline."""
    # The newline keeps a comment at the very end from looking like a terminator.
    found = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(_PIECE), F.lit(0))
    return F.filter(found, lambda p: p != "")


def _blanked(text: Column) -> Column:
    """The text without comments, strings and directives."""
    return F.when(text.rlike("[/\"'@$#]"), F.regexp_replace(text, _OPAQUE, " ")).otherwise(text)


def _count(text: Column, chars: str) -> Column:
    # Not ``translate``, which makes a string of each character.
    rest = text
    for char in chars:
        rest = F.replace(rest, F.lit(char), F.lit(""))
    return F.length(text) - F.length(rest)


def _folded(shape: Column) -> Column:
    """A declaration with its groups folded, innermost first, as often as it has any."""

    def once(x: Column, patterns) -> Column:
        for pattern, mark in patterns:
            x = F.regexp_replace(x, pattern, mark)
        return x

    def repeated(x: Column, openers: str, patterns) -> Column:
        times = _count(x, openers)
        return F.when(
            times > 0, F.aggregate(F.sequence(F.lit(1), times), x, lambda y, _: F.when(_count(y, openers) > 0, once(y, patterns)).otherwise(y))
        ).otherwise(x)

    # What follows an arrow is an expression, in which angles may compare.
    grouped = let(shape, lambda s: repeated(s, "([{", _FOLDS))
    return let(grouped, lambda g: F.concat(
        let(F.substring_index(g, "=>", 1), lambda h: repeated(h, "<", ((_ANGLES, ""),))), F.when(F.contains(g, F.lit("=>")), F.lit("=>")).otherwise("")
    ))


def _branches(open_: Column, piece: Column, depth: Column) -> Column:
    """The open ``#if`` blocks after a piece: the depth each began at, or -1 in a branch that does not count."""

    def follow(c: Column, word: Column) -> Column:
        n = F.size(c)
        below = F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0)))
        return (
            F.when(word == "if", F.concat(c, F.array(depth)))
            .when(n == 0, c)
            .when(word == "endif", below)
            .otherwise(F.concat(below, F.array(F.when(F.element_at(c, -1) == depth, depth).otherwise(F.lit(-1)))))
        )

    words = F.regexp_extract_all(piece, F.lit(_BRANCH), F.lit(1))
    return F.when(F.contains(piece, F.lit("#")), F.aggregate(words, open_, follow)).otherwise(open_)


def method_spans(parts: Column) -> Column:
    """Which pieces form a method: ``array<struct<first, last, kept>>``.

    ``kept`` marks methods inside a struct, interface or record: they are units, and
    they also stay in the skeleton, which is only emptied inside classes.
    """
    zero = F.struct(
        F.lit("").alias("stack"),
        F.lit(-1).alias("first"),
        F.lit(0).alias("base"),
        F.lit(False).alias("arrow"),
        F.lit(False).alias("kept"),
        F.lit(-1).alias("head"),
        F.lit(0).alias("inner"),
        F.array().cast("array<int>").alias("branches"),
        F.array().cast(f"array<{SPAN}>").alias("out"),
    )

    def step(s: Column, piece: Column, ix: Column) -> Column:
        stack = s["stack"]
        depth = F.length(stack)
        return let(_branches(s["branches"], piece, depth), lambda branches: _step(s, piece, ix, stack, depth, branches))

    def _step(s: Column, piece: Column, ix: Column, stack: Column, depth: Column, branches: Column) -> Column:
        opens, shuts, ends = piece.endswith("{"), piece.endswith("}"), piece.endswith(";")
        popped = F.when(depth > 0, F.substr(stack, F.lit(1), depth - 1)).otherwise(stack)

        def span(first, kept):
            return F.array(F.struct(first.alias("first"), ix.alias("last"), kept.alias("kept")))

        def state(stack, first=F.lit(-1), base=F.lit(0), arrow=F.lit(False), kept=F.lit(False), head=F.lit(-1), inner=F.lit(0), out=s["out"]):
            return F.struct(
                stack.alias("stack"), first.alias("first"), base.alias("base"), arrow.alias("arrow"), kept.alias("kept"),
                head.alias("head"), inner.alias("inner"), branches.alias("branches"), out.alias("out"),
            )

        same = state(stack, s["first"], s["base"], s["arrow"], s["kept"], s["head"], s["inner"])

        # Inside a method only the depth matters.
        after = F.when(opens, F.concat(stack, F.lit(_BLK))).when(shuts, popped).otherwise(stack)
        closes = F.when(s["arrow"], ends & (depth <= s["base"])).otherwise(shuts & (depth <= s["base"] + 1))
        inside = F.when(
            closes, state(after, out=F.concat(s["out"], span(s["first"], s["kept"])))
        ).otherwise(state(after, s["first"], s["base"], s["arrow"], s["kept"]))

        in_type = stack.endswith(_CLS) | stack.endswith(_TYP)
        in_other_type = F.contains(stack, F.lit(_TYP))
        start = F.when(s["head"] >= 0, s["head"]).otherwise(ix)
        whole = F.when(s["head"] >= 0, F.array_join(take(parts, start, ix - start + 1), "")).otherwise(piece)

        def kind(shape: Column) -> Column:
            return (
                F.when(in_type & shape.rlike(_METHOD), F.when(F.contains(shape, F.lit("=>")), _ARROW).otherwise(_BODY))
                .when(ends, _PLAIN)
                .when(shape.rlike(_CLASS), _CLS)
                .when(shape.rlike(_OTHER_TYPE), _TYP)
                .when(shape.rlike(_NAMESPACE), _NS)
                .otherwise(_BLK)
            )

        def enter(kind: Column) -> Column:
            method = kind.isin(_BODY, _ARROW)
            pushed = F.when(opens, F.concat(stack, F.lit(_BLK))).otherwise(stack)
            return (
                F.when(kind == _PLAIN, state(stack))
                .when(method & ends, state(stack, out=F.concat(s["out"], span(start, in_other_type))))
                .when(method, state(pushed, start, depth, kind == _ARROW, in_other_type))
                .otherwise(state(F.concat(stack, kind)))
            )

        def declared(shape: Column) -> Column:
            """``shape``: this piece, blanked."""
            inner = F.greatest(s["inner"] + _count(shape, "([") - _count(shape, ")]"), F.lit(0))
            shuts_here = state(popped)
            return let(inner, lambda inner: (
                F.when(inner > 0, state(stack, head=start, inner=inner))
                .when(shuts, shuts_here)
                .otherwise(let(_folded(_blanked(whole)), lambda shape: let(kind(shape), enter)))
            ))

        outside = (
            F.when(stack.endswith(_BLK), F.when(opens, state(F.concat(stack, F.lit(_BLK)))).when(shuts, state(popped)).otherwise(same))
            .when(opens | ends | shuts, let(_blanked(piece), declared))
            .otherwise(same)
        )
        # Most pieces are statements of some body: they change nothing. Nor does what a second branch repeats.
        statement = ends & ~s["arrow"] & ((s["first"] >= 0) | stack.endswith(_BLK))
        return F.when(statement | F.array_contains(branches, -1), same).when(s["first"] >= 0, inside).otherwise(outside)

    def finish(s: Column) -> Column:
        unclosed = F.array(
            F.struct(s["first"].alias("first"), (F.size(parts) - 1).alias("last"), s["kept"].alias("kept"))
        )
        return F.when(s["first"] >= 0, F.concat(s["out"], unclosed)).otherwise(s["out"])

    fields = ["stack", "first", "base", "arrow", "kept", "head", "inner", "branches"]
    return let(fold(parts, zero, fields, step), finish)


def method_units(parts: Column, spans: Column) -> Column:
    """Full text of each method, from its first token to its closing brace, in order."""

    def unit(span: Column) -> Column:
        head = F.regexp_replace(F.get(parts, span["first"]), _LEAD, "")
        tail = take(parts, span["first"] + 1, span["last"] - span["first"])
        # An unclosed last method runs to the end of the text; nothing trails a closed one.
        return F.regexp_replace(F.concat(head, F.array_join(tail, "")), r"\s++\z", "")

    return F.transform(spans, unit)


def cut_spans(spans: Column) -> Column:
    """The spans that leave the skeleton. Keep it as a column of its own: ``class_skeleton`` reads it often."""
    return F.filter(spans, lambda s: ~s["kept"])


def class_skeleton(parts: Column, cut: Column) -> Column:
    """Everything but the methods, joined in order."""

    def gap(i: Column) -> Column:
        start = F.when(i > 0, F.get(cut, i - 1)["last"] + 1).otherwise(F.lit(0))
        stop = F.coalesce(F.get(cut, i)["first"], F.size(parts))
        lead = F.coalesce(F.regexp_extract(F.get(parts, F.get(cut, i)["first"]), _LEAD, 0), F.lit(""))
        return F.concat(F.array_join(take(parts, start, stop - start), ""), lead)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(cut)), gap), "")
