"""Inputs the registered queries run on, derived by Spark from the given tables."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.rows import spread

ROOT = "/corpus"

# Everything but letters, digits, blanks and newlines. Without ranges, Java looks the class up in a table.
_UNSAID = f"[^{string.ascii_letters}{string.digits} \\n]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    """The documents; ``busy`` work gets them spread over all cores if the files alone would not."""
    found = table(spark, sf_dir, "documents")
    return spread(found, "doc_id") if busy else found


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def sources(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    """``doc_id, path, text``: one C# file per document, one method per line.

    Blocks, expression bodies and bodyless methods take turns; braces stand in attributes, strings
    and comments, types are nested deeply, a constructor and a property hold none of the methods, and a nested
    struct has one that is also part of the skeleton.
    """
    ident = F.col("doc_id").cast("string")

    def method(said: Column, i: Column) -> Column:
        n = i.cast("string")
        block = _text(
            '[TestCase(new[] { 1, 2 }), Obsolete("use M{")]\n        public void M', n, "(string s, int n = 0)\n        {\n"
            '            // } not a brace {{\n            if (n > 0) { Log($"{names["{"]}", "', said, ' {"); }\n        }'
        )
        arrow = _text("internal static Dictionary<string, List<Dictionary<string, List<int>>>> M", n, '<T>(T a) => Make(a, "', said, '");')
        bare = _text("protected abstract (int, (int, (int, string)))[] M", n, "();")
        body = F.when(i % 3 == 0, block).when(i % 3 == 1, arrow).otherwise(bare)
        return _text("\n        /// <summary>", n, "</summary>\n        ", body, "\n")

    text = _text(
        "using System;\n#region R\nnamespace Corpus.", F.col("source"), "\n{\n    // holds { one class\n    [Serializable]\n"
        "    public class Doc", ident, " : Base<", F.col("lang"), '>\n    {\n        private const string Brace = "}{ \\"{";\n'
        "        internal int X { get; set; }\n\n        public Doc", ident, "(int x)\n        {\n"
        "            if (x > 0) { X = x; }\n        }\n",
        F.array_join(F.transform(lines(F.regexp_replace("text", _UNSAID, "")), method), ""),
        "\n        struct Pair\n        {\n            public int Sum() => 1;\n        }\n    }\n}\n#endregion",
    )
    seventh, eleventh = F.col("doc_id") % 7, F.col("doc_id") % 11
    place = F.when(seventh == 0, "Library").when(seventh == 1, "LibraryCache").otherwise("Assets")
    path = _text(
        ROOT + "/", place, "/", F.initcap("source"), "/MyDoc", ident, "Source_file",
        F.when(eleventh == 0, ".txt").when(eleventh == 1, "").otherwise(".cs"),
    )
    return documents(spark, sf_dir, busy).select("doc_id", path.alias("path"), text.alias("text"))


def replies(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    """``doc_id, reply``: documents in five shapes of model reply."""
    t, fifth = F.col("text"), F.col("doc_id") % 5
    reply = (
        F.when(fifth == 0, _text("```cs\n", t, "\n```"))
        .when(fifth == 1, _text("Sure:\n```\n", t, "\n```\nbye\n```cpp\n", F.col("source"), "\n```"))
        .when(fifth == 2, t)
        .when(fifth == 3, _text("```\n", t))
        .otherwise(_text("// A.h\n", t, "\n```\n  // A.cpp\n", F.col("source"), "\n"))
    )
    return documents(spark, sf_dir, busy).select("doc_id", reply.alias("reply"))


def pairs(spark: SparkSession, sf_dir: str, asked: str = "user", answered: str = "assistant") -> DataFrame:
    """``conv_id, turn, source, target``: a turn and the answer that follows it.

    The join key has the turn in it, so one long conversation spreads over all tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    a = turns.filter(F.col("role") == asked).select("conv_id", "turn", F.col("text").alias("source"))
    b = turns.filter(F.col("role") == answered).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    return a.join(b, ["conv_id", "turn"])


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p_partkey, name``: identifiers in mixed case."""
    name = _text("partItem", F.replace("p_name", F.lit(" "), F.lit("_")), "Brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
