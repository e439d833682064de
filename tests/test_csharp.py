import re

import pytest
from pyspark.sql import functions as F

from glyphmill.operators.segmenting import segment

PLAIN = '''using Game.World;

public class Door
{
    private bool open;
    private List<Key> keys;

    public Door(int locks)
    {
        open = locks == 0;
#if DEBUG
        keys = null;
#endif
    }

#region Moving
    public void Push(float force, Key key)
    {
        open = force > 1;
    }
#endregion

    public bool Fits(List<Key> tried)
    {
        if (tried != null) { return keys == tried; }
        return false;
    }
}'''

TRICKY = r'''namespace A.B
{
    // not a method() {
    /* void Hidden() { */
    [Serializable, Tip("{[(")]
    public abstract class Outer<T> : Base<T>, IThing where T : new()
    {
        private readonly Action<int> field = x => { Call(x); };
        private int[] table = { 1, 2, 3 };
        private string verbatim = @"c:\{""quoted""}";
        private string normal = "\"}{\\";
        private char brace = '{', quote = '\'';
        public int Size { get; set; } = 3;
        public int Area => Size * Size;
        public event Action Changed { add { Add(value); } remove { Drop(value); } }
        public delegate void Handler(int x);
        public int this[int i] { get { return table[i]; } }
        static Outer() { Init(); }
        ~Outer() { Free(); }
        public static Outer<T> operator +(Outer<T> a, Outer<T> b) { return a; }
        public static implicit operator int(Outer<T> a) => 1;

        /// <summary>Documented { method</summary>
        [Obsolete("use {"), Conditional("X")]
        [return: NotNull]
        public override async Task<Dictionary<string, List<int[]>>> Load<U>(
            string path = "}",
            params (int, string)[] rest)
            where U : class
        {
            void Local() { Inner(); }
            foreach (var x in rest) { if (x.Item1 > 0) return new Foo() { A = 1 }; }
            Func<int, int> f = y => { return y; };
            var s = $"{path}{{";
            return null;
        }

        public abstract string[] Names();
        (int, string)? Pair() => (1, "a;b");
        IEnumerator IEnumerable<T>.Each<V>() => list.Select(x => { return x; }).Each();
        unsafe int* Raw(int* p) { return p; }

        public struct Point
        {
            public int X;
            public int Sum() { return X; }
        }

        class Nested
        {
            void Deep() { }
        }

        interface IThing { void Do(int n); }
        enum Kind { A, B }
    }
}
'''


def cut(spark, text):
    row = segment(spark.createDataFrame([(text,)], "text string")).first()
    return row["units"], row["skeleton"]


def squeeze(s):
    return re.sub(r"\s+", " ", s).strip()


def test_methods_and_skeleton_of_a_plain_class(spark):
    units, skeleton = cut(spark, PLAIN)
    assert units == [
        "public void Push(float force, Key key)\n    {\n        open = force > 1;\n    }",
        "public bool Fits(List<Key> tried)\n    {\n        if (tried != null) { return keys == tried; }\n        return false;\n    }",
    ]
    assert squeeze(skeleton) == squeeze(
        "using Game.World; public class Door { private bool open; private List<Key> keys; "
        "public Door(int locks) { open = locks == 0; #if DEBUG keys = null; #endif } #region Moving #endregion }"
    )


def test_what_is_a_method_and_what_is_not(spark):
    units, skeleton = cut(spark, TRICKY)
    heads = [squeeze(u)[:40] for u in units]
    assert heads == [
        '[Obsolete("use {"), Conditional("X")] [r',
        "public abstract string[] Names();",
        '(int, string)? Pair() => (1, "a;b");',
        "IEnumerator IEnumerable<T>.Each<V>() => ",
        "unsafe int* Raw(int* p) { return p; }",
        "public int Sum() { return X; }",
        "void Deep() { }",
        "void Do(int n);",
    ]
    assert units[0].endswith("return null;\n        }")
    assert units[3] == "IEnumerator IEnumerable<T>.Each<V>() => list.Select(x => { return x; }).Each();"
    # Gone from classes, kept in structs and interfaces.
    for gone in units[:5] + [units[6]]:
        assert gone not in skeleton
    for kept in (units[5], units[7]):
        assert kept in skeleton
    for part in ("Documented { method", "operator +", "~Outer()", "delegate void Handler", "remove { Drop(value); }", "enum Kind"):
        assert part in skeleton


def test_nothing_is_lost(spark):
    from glyphmill.functions import csharp

    for text in (PLAIN, TRICKY, "", "}", "{{{", "class A {", 'class A { string s = "', "/* open", "class A { void F() { /* } "):
        df = spark.createDataFrame([(text,)], "text string").select(csharp.pieces(F.col("text")).alias("p"))
        assert "".join(df.first()["p"]) == text + "\n"
    units, skeleton = cut(spark, PLAIN)
    rest = PLAIN
    for u in units:
        rest = rest.replace(u, "", 1)
    assert skeleton == rest + "\n"


@pytest.mark.parametrize("end", ["", "\n", "\n\n  // trailing"])
def test_unclosed_method_runs_to_the_end(spark, end):
    units, skeleton = cut(spark, "class A\n{\n    int x;\n    public void Open(int y)\n    {\n        Use(y);" + end)
    assert units == [("public void Open(int y)\n    {\n        Use(y);" + end).rstrip()]
    assert squeeze(skeleton) == "class A { int x;"


def test_long_lines_do_not_overflow_the_stack(spark):
    blob = '"' + "a\\n" * 200_000 + '"'
    body = "Call(" + "x+" * 200_000 + "1);"
    text = "class A\n{\n    string s = " + blob + ";\n    // " + "{" * 200_000 + "\n    void F()\n    {\n        " + body + "\n    }\n}"
    units, skeleton = cut(spark, text)
    assert units == ["void F()\n    {\n        " + body + "\n    }"]
    assert blob in skeleton


def test_many_methods_pack_as_expected(spark):
    from glyphmill.functions.packing import pack_by_chars

    method = "    public int M{0}(int a)\n    {{\n        return a + {0};\n    }}\n\n"
    text = "namespace N\n{\nclass Long\n{\n" + "".join(method.format(i) for i in range(3000)) + "}\n}\n"
    df = segment(spark.createDataFrame([(text,)], "text string"))
    row = df.select("units", "skeleton", pack_by_chars(F.col("units"), 1000).alias("b")).first()
    assert len(row["units"]) == 3000
    assert row["b"][0].startswith("\n\npublic int M0(")
    assert "\n\n".join(row["b"]) == "\n\n" + "\n\n".join(row["units"])
    assert all(len(b) < 1000 for b in row["b"])
    assert squeeze(row["skeleton"]) == "namespace N { class Long { } }"


SHAPES = '''class A
{
    [TestCase(new[] { 1, 2 })] public void Braced(int a) { One(); }
    [InlineData(new object[] { "a;}" }, Make = new() { X = { 1 } })]
    [Other]
    internal Dictionary<string, List<Dictionary<string, List<int>>>> Deep<T, U>(Func<Func<Func<int>>> f) => a < b && f() > c;
    (int, (int, (int, (int, int)))) Tuple((int, int) x = default) { return ((1, (2, 3))); }
    string Said(D d) { return $"{d["{"]}" + $"{{{d[$"x"]}"; }
    void Params(Action a = null, int[] b = new[] { 1, 2 }) { a(); }
    [Range(0, 1)] private int field;
    private static readonly Foo f = Make(new[] { 1, 2 }, () => { return 3; });
    char c = '\\u007b', d = '}';
    void Last() { }
}'''


def test_groups_in_declarations_have_no_limit(spark):
    units, skeleton = cut(spark, SHAPES)
    assert [next(n for n in ("Braced(", "Deep<", "Tuple(", "Said(", "Params(", "Last(") if n in u) for u in units] == [
        "Braced(", "Deep<", "Tuple(", "Said(", "Params(", "Last(",
    ]
    assert units[0] == "[TestCase(new[] { 1, 2 })] public void Braced(int a) { One(); }"
    assert units[1].startswith("[InlineData(") and units[1].endswith("=> a < b && f() > c;")
    assert squeeze(skeleton) == squeeze(
        "class A { [Range(0, 1)] private int field; private static readonly Foo f = Make(new[] { 1, 2 }, () => { return 3; }); char c = '\\u007b', d = '}'; }"
    )


BRANCHES = '''class A
{
#if X
    public void First(int a)
    {
#elif Y
    public void First(long a)
    {
#else
    public void First()
    {
#endif
        Body();
    }
    void Second() { Two(); }
#if EDITOR
    void Third() { Three(); }
#else
    void Third(int a) { Three(a); }
#endif
    void Fourth()
    {
#if X
        if (a) {
#else
        if (b) {
#endif
        }
    }
    void Fifth() { }
}'''


@pytest.mark.parametrize("comment", ["", "// "])
def test_branches_that_open_differently_count_once(spark, comment):
    units, _ = cut(spark, BRANCHES.replace("#", comment + "#"))
    assert [u.split("(")[0].split()[-1] for u in units] == ["First", "Second", "Third", "Third", "Fourth", "Fifth"]
    assert units[0].endswith("Body();\n    }") and units[1] == "void Second() { Two(); }"
    assert units[4].rstrip().endswith("}\n    }")


def test_a_long_file_is_packed_into_a_known_number_of_batches(spark):
    from glyphmill.functions.packing import pack_by_chars

    kinds = [
        "    [TestCase(new[] {{ {0} }})]\n    public int M{0}(int a)\n    {{\n        return a + {0};\n    }}\n", "    (int, (int, int)) M{0}() => (1, ({0}, 2));\n",
        "    Task<Dictionary<int, List<List<int>>>> M{0}(int[] a = null);\n",
    ]
    text = "namespace N\n{\nclass Long\n{\n" + "".join(kinds[i % 3].format(i) for i in range(240)) + "}\n}\n"
    row = segment(spark.createDataFrame([(text,)], "text string")).select("units", pack_by_chars(F.col("units"), 600).alias("b")).first()
    assert (len(row["units"]), len(row["b"])) == (240, 27)


def test_names_of_any_script(spark):
    names = ["Épée", "Größe", "名前", "Ünï_1", "@event", "\\u0041b", "áx"]
    units = [f"public void {n}(int a) {{ int x = a; }}" for n in names]
    text = "class Ärger\n{\n    int y;\n    " + "\n    ".join(units) + "\n    Größe M<Größe>() => null;\n}"
    from glyphmill.operators.segmenting import segment

    row = segment(spark.createDataFrame([("a", text)], "path string, text string")).first()
    assert [u.strip() for u in row["units"]] == [*units, "Größe M<Größe>() => null;"]
    assert "Épée" not in row["skeleton"] and "int y;" in row["skeleton"]
