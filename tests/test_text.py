import random
import re

from glyphmill.functions import paths
from glyphmill.functions import text as T


def fuzz(seed, alphabet, n, longest):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(longest))) for _ in range(n)]


def test_strip_knows_every_python_whitespace(column_of):
    assert sorted(T.PY_WS) == sorted(c for c in map(chr, range(0x110000)) if c.isspace())
    values = fuzz(1, list(T.PY_WS) + ["a", "b", "é"], 200, 12)
    assert column_of(values, T.strip) == [v.strip() for v in values]
    assert column_of(values, T.lstrip) == [v.lstrip() for v in values]
    assert column_of(values, T.rstrip) == [v.rstrip() for v in values]


def test_line_breaks_are_those_of_python(column_of):
    values = fuzz(2, ["a", "\n", "\r", "\x0b", "\x1c", "\x85", "\u2028", " "], 300, 9)
    got = column_of(values, T.one_break)
    assert [g.removesuffix("\n").split("\n") if g else [] for g in got] == [v.splitlines() for v in values]


def test_newlines_become_universal(column_of):
    values = fuzz(3, ["a", "\n", "\r", "\r\n"], 100, 8)
    assert column_of(values, T.normalize_newlines) == [re.sub("\r\n?", "\n", v) for v in values]


def test_directive_lines_become_comments(column_of):
    values = ["#if A\n  #endif\nint x; # no\n\t\u3000#region\n", "", "#", "a\n\n#b\r"] + fuzz(4, ["#", " ", "\n", "x", "\x0b"], 200, 10)

    def model(text):
        return "".join(("// " if line.strip().startswith("#") else "") + line + "\n" for line in text.split("\n"))

    assert column_of(values, T.directives_to_comments) == [model(v) for v in values]


def test_indent_conversions(column_of):
    s = "\ta    b\t     c"
    assert column_of([s], lambda c: T.convert_indent(c)) == [s]
    assert column_of([s], lambda c: T.convert_indent(c, tabs_to_spaces=True)) == ["    a    b         c"]
    assert column_of([s], lambda c: T.convert_indent(c, spaces_to_tabs=True)) == ["\ta\tb\t\t c"]
    assert column_of([s], lambda c: T.convert_indent(c, True, True)) == ["\ta\tb\t\t c"]


def test_first_code_block(column_of):
    replies = {
        "\n```\ncode\n```\n": "code",
        "before\n```cs\ncode\n```\nafter": "code",
        "  before\n  ```h\n  code\n  ```\n  ```cpp\n  other\n  ```": "code",
        "\n code \n": "code",
        "```\n```\ntext": "",
        "```\nnever closed": "```\nnever closed",
        "``` no newline ```": "``` no newline ```",
        "```a```\nb```c": "b",
        "": "",
    }
    assert column_of(list(replies), T.first_code_block) == list(replies.values())


def test_first_code_block_fuzzed(column_of):
    values = fuzz(5, ["```", "`", "\n", "a", " "], 500, 9)

    def model(reply):
        before, mark, after = reply.partition("```")
        _, newline, body = after.partition("\n")
        block, closing, _ = body.partition("```")
        return (block if mark and newline and closing else reply).strip()

    assert column_of(values, T.first_code_block) == [model(v) for v in values]


def test_first_code_block_with_another_fence(column_of):
    assert column_of(["x $$$\ny\n$$$"], lambda c: T.first_code_block(c, "$$$")) == ["y"]


def header_model(reply):
    """Line by line: which part is open, and whether a comment has named one."""
    kept, open_part, named = {"h": [], "i": []}, None, False
    for line in reply.splitlines():
        bare = line.strip()
        fence = bare.startswith("```")
        named_part = None
        if not fence and bare.startswith("//"):
            named_part = "h" if bare.endswith(".h") else "i" if bare.endswith(".cpp") else None
        if fence and not named:
            open_part = None if open_part else ("i" if kept["h"] else "h")
        elif named_part:
            open_part, named = named_part, True
        elif not fence and open_part:
            kept[open_part].append(line)
    if not kept["h"] and not kept["i"]:
        return reply.strip(), "SEE HEADER FOR FULL RESPONSE"
    return "\n".join(kept["h"]).strip(), "\n".join(kept["i"]).strip()


def test_header_and_implementation(column_of):
    fences = "  ```cpp\n  head\n  ```\n  ```cpp\n  body\n  ```\n"
    titled = "// Header:\n```\nhead\n```\n// Implementation:\n```\nbody\n```\nbye"
    mixed = "  // A.h\n  ```\n  head\n  ```\n  // A.cpp\n  ```\n  body\n  ```"
    comments = "\n // A.h\n\n head\n\n // A.cpp\n\n body\n"
    got = column_of([fences, titled, mixed, comments], T.header_and_implementation)
    assert [tuple(g) for g in got] == [("head", "body")] * 4
    assert tuple(column_of([" nothing \n"], T.header_and_implementation)[0]) == (
        "nothing", "SEE HEADER FOR FULL RESPONSE",
    )


def test_header_and_implementation_fuzzed(column_of):
    r = random.Random(6)
    parts = ["```", " ```cpp", "// A.h", "  // B.cpp ", "// A.h:", "x", "  y ", "", "// see C.h", "/ .h", "x ```", "a\x0b```", "\r", "//.h", "// x.h.cpp"]
    values = ["\n".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(1500)]
    got = column_of(values, T.header_and_implementation)
    assert [tuple(g) for g in got] == [header_model(v) for v in values]


def test_case_conversions(column_of):
    assert column_of(["HTTPServer", "Level2Boss", "fooBarBaz", "ÀéB", ""], T.camel_to_snake) == [
        "httpserver", "level2boss", "foo_bar_baz", "àéb", "",
    ]
    values = ["my_fooBar_x", "plain", "_a_b", "a__b", "a_", "", "SHOUT_LOUD", "x_éa"]
    words = [v.split("_") for v in values]
    assert column_of(values, T.snake_to_camel) == [w[0] + "".join(x.capitalize() for x in w[1:]) for w in words]


def test_extension_and_stem(column_of):
    import os

    names = ["a.cs", "A.b.cs", ".cs", "x.CS", "noext", "a.", "...", "..a.b", ".a.b", "a..cs", "d.x/y", "d.x/.y", "d/z.tar.gz"]
    assert column_of(names, paths.extension) == [os.path.splitext(n)[1] for n in names]
    bases = [os.path.basename(n) for n in names]
    assert column_of(bases, paths.stem) == [os.path.splitext(b)[0] for b in bases]


def test_destination_paths(column_of):
    source = ["/in/Top/Rooms/HallLamp.cs", "/in/Front_Door.cs"]

    def dest(**how):
        return column_of(source, lambda c: paths.destination_path(c, "/in/", "/made", ".gd", **how))

    assert dest() == ["/made/Top/Rooms/HallLamp.gd", "/made/Front_Door.gd"]
    assert dest(camel_case=True) == ["/made/Top/Rooms/HallLamp.gd", "/made/FrontDoor.gd"]
    assert dest(snake_case=True) == ["/made/Top/Rooms/hall_lamp.gd", "/made/front_door.gd"]
    assert dest(lower_folders=True) == ["/made/top/rooms/HallLamp.gd", "/made/Front_Door.gd"]
    assert dest(camel_case=True, snake_case=True)[1] == "/made/FrontDoor.gd"


def test_patterns_that_pass_over_whole_texts_are_looked_up_in_tables(column_of):
    assert "-" not in T._RARE_BREAK and max(T._RARE_BREAK) < "\u0100"
    assert T._INLINE_WS.startswith("[ \t]*+")
    assert column_of([f"a{c}b" for c in "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"], T.one_break) == ["a\nb"] * 9
    assert column_of(["  \t\u3000  #if\n \u2028#x"], T.directives_to_comments) == ["//   \t\u3000  #if\n//  \u2028#x\n"]
