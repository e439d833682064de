"""The registered queries: each operator over whole tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill import views
from glyphmill.functions import paths
from glyphmill.functions import text as T
from glyphmill.functions.embedding import TrigramEmbedder
from glyphmill.functions.packing import pack, pack_by_chars
from glyphmill.functions.rows import explode_indexed
from glyphmill.functions.tokens import CharCounter, RunCounter
from glyphmill.operators import assembling, inference, reading, requests, retrieval, routing, segmenting, vector_index
from glyphmill.plans import jobs
from glyphmill.plans.profiles import SINGLE_FILE, TWO_FILES, KnownPairs, Profile
from glyphmill.plans.translation import Translation, requests_for, to_each, to_single_file, to_two_files
from glyphmill.scratch import materialize, scratch_dir
from glyphmill.sources import committed
from glyphmill.sources import files as sink
from glyphmill.sources import pairs as pair_source
from glyphmill.sources import tree
from glyphmill.sources.keyed import KeyedTable, embed_stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the queries; the SQL in catalog_sql.py uses the same values.
LIMIT = 1000
WHOLE_LIMIT = 2000
RUN_LIMIT = 200
NEIGHBOURS = 5
EXAMPLES = 2
SYSTEM = "Answer with code only."
USER_REQUEST = "Known:\n${SOURCE}\nbecomes\n${TARGET}"
ASSISTANT_RESPONSE = "Noted."
PROMPT_TEMPLATE = "[INST]${PROMPT}[/INST]"
PROMPTS = {"full": "Translate:\n${CODE}", "class_only": "Class:\n${CODE}\n${METHODS}", "methods_only": "Methods:\n${CODE}"}
TWO_FILE_PROMPTS = {
    "full": "// A.h\n${CODE}\n// A.cpp\n// body\n${CODE}\n",
    "class_only": "// A.h\n${CODE}\n${METHODS}\n// A.cpp\n// body\n${CODE}\n",
    "methods_only": "// A.h\n${CODE}\n// A.cpp\n// body\n${CODE}\n",
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks ----------------------------------------------------


def _written_tree(spark, outputs: DataFrame, label: str) -> str:
    root = scratch_dir(spark, label)
    done = sink.write_files(outputs.withColumn("dest_path", F.concat(F.lit(root + "/"), F.col("dest_path"))))
    materialize(done, label + "-log")
    return root


@query
def corpus_scan(spark, sf_dir):
    """Documents as a tree with hidden folders and empty files, listed whole."""
    folder = F.concat(F.lit("Assets/"), F.col("source"), F.when(F.col("doc_id") % 13 == 0, "/.cache/").otherwise("/"))
    name = F.concat(F.lit("Doc.v"), F.col("doc_id"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(".cs"))
    content = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("text"))
    tree_of = views.documents(spark, sf_dir, busy=True).select(F.concat(folder, name).alias("dest_path"), content.alias("content"))
    listed = tree.list_tree(spark, _written_tree(spark, tree_of, "scan"))
    return listed.select("rel_path", paths.extension(F.col("rel_path")).alias("ext"), "length")


@query
def corpus_scan_pruned(spark, sf_dir):
    """Documents as a tree with folders that are ignored, of which nothing is opened."""
    seventh = F.col("doc_id") % 7
    top = F.when(seventh == 0, "Library/").when(seventh == 1, "LibraryCache/").when(seventh == 2, "Assets/Library/").otherwise("Assets/")
    path = F.concat(top, F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".cs"))
    tree_of = views.documents(spark, sf_dir, busy=True).select(path.alias("dest_path"), F.col("text").alias("content"))
    return tree.list_tree(spark, _written_tree(spark, tree_of, "pruned"), ignored=["Library", "Packages"]).select("rel_path", "length")


@query
def layout_check(spark, sf_dir):
    found = views.documents(spark, sf_dir).select(F.col("lang").alias("name")).distinct()
    return routing.missing_names(found, ["en", "fr", "xx"])


@query
def read_text_normalized(spark, sf_dir):
    text = F.col("text")
    even = F.when(F.col("doc_id") % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    content = (
        F.when(F.col("doc_id") % 50 == 0, F.encode(F.lit(""), "UTF-8"))
        .when(F.col("doc_id") % 17 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(even, "UTF-8")))
        .otherwise(F.encode(even, "UTF-8"))
    )
    raw = views.documents(spark, sf_dir).select("doc_id", content.alias("content"))
    return reading.with_status(reading.decode_text(raw)).select("doc_id", "status", "error", "text")


@query
def known_pairs_source(spark, sf_dir):
    """Pairs written as JSON lines and read back."""
    path = scratch_dir(spark, "pairs")
    views.pairs(spark, sf_dir).select("source", "target").write.json(path)
    return pair_source.read_pairs(spark, path)


def _numbered_pairs(spark, sf_dir, asked="user", answered="assistant"):
    found = views.pairs(spark, sf_dir, asked, answered)
    return pair_source.number_in_order(found, ["conv_id", "turn"]).select("id", "source", "target")


@query
def known_pairs_upsert(spark, sf_dir):
    """The pairs by number, overwritten by those of the opposite direction."""
    return pair_source.upsert(
        _numbered_pairs(spark, sf_dir), _numbered_pairs(spark, sf_dir, "assistant", "user")
    ).withColumn("id", F.col("id").cast("string"))


@query
def known_pairs_merged(spark, sf_dir):
    """A stored table of pairs after three rounds: all, those of the opposite direction, and a few of the first ones changed."""
    table = KeyedTable(spark, scratch_dir(spark, "stored-pairs"), "id long, source string, target string", "id", buckets=16)
    asked = materialize(_numbered_pairs(spark, sf_dir), "asked")
    table.merge(asked)
    table.merge(_numbered_pairs(spark, sf_dir, "assistant", "user"))
    table.merge(asked.filter("id % 50 = 0").withColumn("target", F.concat("target", F.lit("!"))))
    return table.rows().withColumn("id", F.col("id").cast("string"))


@query
def file_sink(spark, sf_dir):
    """One file per document, read back as bytes."""
    out = views.documents(spark, sf_dir, busy=True).select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("dest_path"), F.col("text").alias("content")
    )
    listed = tree.list_tree(spark, _written_tree(spark, out, "sink"))
    read = reading.decode_text(tree.read_contents(listed))
    doc_id = paths.stem(paths.file_name(F.col("rel_path"))).cast("long")
    return read.select(doc_id.alias("doc_id"), "rel_path", "length", "text")


@query
def file_sink_committed(spark, sf_dir):
    """Two files for each document, both or neither: every 17th has only one that can be written."""
    root = scratch_dir(spark, "committed")
    at = F.concat(F.lit(root + "/"), "source", F.lit("/"), "doc_id")
    pair = F.array(
        F.struct(F.concat(at, F.lit(".h")).alias("dest_path"), F.col("source").alias("content")),
        F.struct(F.concat(at, F.lit(".cpp")).alias("dest_path"), F.when(F.col("doc_id") % 17 != 0, F.col("text")).alias("content")),
    )
    out = views.documents(spark, sf_dir, busy=True).select(F.col("doc_id").cast("string").alias("unit"), F.explode(pair).alias("f"))
    report = committed.write_together(out.select("unit", "f.*"), root)
    failed = report.filter("error is not null").select(F.concat("unit", F.lit(" failed")).alias("rel_path"), F.lit(0).cast("long").alias("length"))
    return tree.list_tree(spark, root).select("rel_path", "length").unionByName(failed.distinct())


# --- filters, routes, names -----------------------------------------------


@query
def ignore_locations(spark, sf_dir):
    kept = routing.ignore_locations(views.sources(spark, sf_dir), views.ROOT, ["Library", "Packages"])
    return kept.select("doc_id", "path")


@query
def route_by_extension(spark, sf_dir):
    routed = routing.route_by_extension(
        views.sources(spark, sf_dir), {".cs": SINGLE_FILE, ".txt": TWO_FILES, ".md": None}
    )
    return routed.select("doc_id", "path", "strategy")


@query
def destination_path(spark, sf_dir):
    at = F.col("path")
    return views.sources(spark, sf_dir).select(
        "doc_id",
        paths.destination_path(at, views.ROOT, "/out/", ".gd", lower_folders=True, snake_case=True).alias("snake"),
        paths.destination_path(at, views.ROOT + "/", "/out", ".h", camel_case=True, snake_case=True).alias("camel"),
        paths.destination_path(at, views.ROOT, "/out", ".cs").alias("plain"),
    )


@query
def destination_collisions(spark, sf_dir):
    """Names that differ only in ways a destination does not: the smallest path wins."""
    name = F.when(F.col("doc_id") % 2 == 0, "FooBar").otherwise("foo_bar")
    path = F.concat(F.lit(views.ROOT + "/Assets/"), name, F.floor(F.col("doc_id") / 2).cast("string"), F.lit("."), "source")
    placed = views.documents(spark, sf_dir).select("doc_id", path.alias("path"))
    placed = placed.withColumn("dest_path", paths.destination_path(F.col("path"), views.ROOT, "/out", ".gd", snake_case=True))
    return routing.mark_collisions(placed).select("doc_id", "path", "dest_path", "wins")


@query
def camel_to_snake(spark, sf_dir):
    return views.names(spark, sf_dir).select("p_partkey", T.camel_to_snake(F.col("name")).alias("name"))


@query
def snake_to_camel(spark, sf_dir):
    return views.names(spark, sf_dir).select("p_partkey", T.snake_to_camel(F.col("name")).alias("name"))


# --- text -----------------------------------------------------------------


@query
def macros_to_comments(spark, sf_dir):
    return views.sources(spark, sf_dir, busy=True).select("doc_id", T.directives_to_comments(F.col("text")).alias("text"))


@query
def convert_indent(spark, sf_dir):
    widened = F.array_join(
        F.transform(
            views.lines(F.col("text")),
            lambda l, i: F.when(i % 3 == 0, F.replace(l, F.lit(" "), F.lit("    "))).otherwise(
                F.replace(l, F.lit(", "), F.lit(",\t"))
            ),
        ),
        "\n",
    )
    return views.documents(spark, sf_dir).select("doc_id", widened.alias("text")).select(
        "doc_id",
        T.convert_indent(F.col("text"), tabs_to_spaces=True).alias("spaces"),
        T.convert_indent(F.col("text"), spaces_to_tabs=True).alias("tabs"),
        T.convert_indent(F.col("text"), True, True).alias("both"),
    )


@query
def extract_first_code(spark, sf_dir):
    return views.replies(spark, sf_dir).select("doc_id", T.first_code_block(F.col("reply")).alias("code"))


@query
def extract_header_impl(spark, sf_dir):
    split = views.replies(spark, sf_dir, busy=True).select("doc_id", T.header_and_implementation(F.col("reply")).alias("s"))
    return split.select("doc_id", "s.header", "s.implementation")


# --- budget, units, batches -----------------------------------------------


@query
def token_count(spark, sf_dir):
    return views.documents(spark, sf_dir).select("doc_id", CharCounter().count(F.col("text")).alias("n_tokens"))


@query
def token_count_words(spark, sf_dir):
    """Runs of characters of a kind, and what a text adds behind a blank line."""
    runs, text = RunCounter(), F.col("text")
    after = runs.joined(runs.summary(F.lit("\n\n")), runs.summary(text))
    return views.documents(spark, sf_dir).select("doc_id", runs.count(text).alias("n_tokens"), after["n"].alias("n_after_break"))


@query
def budget_split(spark, sf_dir):
    n = CharCounter().count(F.col("text"))
    return views.documents(spark, sf_dir).select(
        "doc_id", n.alias("n_tokens"), F.when(segmenting.fits(n, WHOLE_LIMIT), "whole").otherwise("segmented").alias("way")
    )


def _segmented(spark, sf_dir):
    commented = views.sources(spark, sf_dir, busy=True).withColumn("text", T.directives_to_comments(F.col("text")))
    return segmenting.segment(commented)


@query
def segment_units(spark, sf_dir):
    return explode_indexed(_segmented(spark, sf_dir), ["doc_id"], "units", "unit_ix", "text")


@query
def segment_skeleton(spark, sf_dir):
    return _segmented(spark, sf_dir).select("doc_id", "skeleton")


def _batches(spark, sf_dir):
    units = views.lines(F.col("text"))
    return explode_indexed(views.documents(spark, sf_dir), ["doc_id"], pack_by_chars(units, LIMIT), "batch_ix", "text")


@query
def pack_units(spark, sf_dir):
    return _batches(spark, sf_dir)


@query
def pack_units_nonempty(spark, sf_dir):
    batches = pack(views.lines(F.col("text")), CharCounter(), LIMIT, drop_empty=True)
    return explode_indexed(views.documents(spark, sf_dir), ["doc_id"], batches, "batch_ix", "text")


@query
def pack_units_counted(spark, sf_dir):
    """Batches under a number of runs, which joining can merge."""
    batches = pack(views.lines(F.col("text")), RunCounter(), RUN_LIMIT)
    return explode_indexed(views.documents(spark, sf_dir), ["doc_id"], batches, "batch_ix", "text")


@query
def request_union(spark, sf_dir):
    """Whole files and cut ones as one table of pieces, from one pass."""
    commented = views.sources(spark, sf_dir, busy=True).withColumn("text", T.directives_to_comments(F.col("text")))
    return segmenting.plan_pieces(commented, CharCounter(), WHOLE_LIMIT).select("doc_id", "kind", "piece_ix", "code")


# --- requests -------------------------------------------------------------


@query
def render_prompt(spark, sf_dir):
    """Every document under each kind of prompt, and under one that is not defined."""
    kinds = F.explode(F.array(*[F.lit(k) for k in [*PROMPTS, "other"]]))
    pieces = views.documents(spark, sf_dir).select("doc_id", F.col("text").alias("code"), kinds.alias("kind"))
    return requests.render_prompt(pieces, PROMPTS).select("doc_id", "kind", "user", "error")


def _pair_history(spark, sf_dir):
    examples = F.array(F.struct("source", "target"))
    return views.pairs(spark, sf_dir).withColumn(
        "history", requests.example_messages(examples, USER_REQUEST, ASSISTANT_RESPONSE)
    )


def _messages(df, keys, column):
    return explode_indexed(df, keys, column, "msg_ix", "m").select(*keys, "msg_ix", "m.role", "m.content")


@query
def fewshot_history(spark, sf_dir):
    return _messages(_pair_history(spark, sf_dir), ["conv_id", "turn"], "history")


@query
def assemble_messages(spark, sf_dir):
    """System rules on even conversations only."""
    rules = F.when(F.col("conv_id") % 2 == 0, SYSTEM)
    chat = requests.assemble_messages(F.col("source"), rules, F.col("history"))
    return _messages(_pair_history(spark, sf_dir), ["conv_id", "turn"], chat)


@query
def flatten_messages(spark, sf_dir):
    rules = F.when(F.col("conv_id") % 2 == 0, SYSTEM)
    flat = requests.flatten_messages(PROMPT_TEMPLATE, F.col("source"), rules, F.col("history"))
    return _pair_history(spark, sf_dir).select("conv_id", "turn", flat.alias("prompt"))


# --- retrieval ------------------------------------------------------------


@query
def embed_text(spark, sf_dir):
    vectors = retrieval.embed(views.documents(spark, sf_dir).select("doc_id", "text"), TrigramEmbedder())
    return explode_indexed(vectors, ["doc_id"], "vec", "bucket", "w").select(
        "doc_id", "bucket", F.round("w", 9).alias("weight")
    )


@query
def embed_text_stored(spark, sf_dir):
    """The same vectors from a store that a first run has filled; ``embedded`` counts the texts that the second one embeds."""
    docs, store = views.documents(spark, sf_dir).select("doc_id", "text"), scratch_dir(spark, "vectors")
    embed_stored(docs, TrigramEmbedder(), store)
    vectors, embedded = embed_stored(docs, TrigramEmbedder(), store)
    return explode_indexed(vectors, ["doc_id"], "vec", "bucket", "w").select(
        "doc_id", "bucket", F.round("w", 9).alias("weight"), F.lit(embedded).cast("long").alias("embedded")
    )


def _neighbours(spark, sf_dir, **how):
    vectors = views.table(spark, sf_dir, "embeddings")
    hits = retrieval.nearest(
        vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")),
        vectors.select(F.col("vec_id").alias("known_id"), F.col("embedding").alias("vec")),
        NEIGHBOURS, **how,
    )
    return hits.select("query_id", "rank", "known_id", F.round("distance", 6).alias("distance"))


@query
def knn_exact(spark, sf_dir):
    return _neighbours(spark, sf_dir)


@query
def knn_in_blocks(spark, sf_dir):
    """The same neighbours by the way taken when the known side is too large to send."""
    return _neighbours(spark, sf_dir, max_local_bytes=0)


@query
def knn_ivf(spark, sf_dir):
    """Neighbours by an inverted file over every row, for the ids divisible by 100, held against the exact ones.

    ``exact`` says whether a neighbour is among the exact ones, ``recall`` how many of all are; ``compared`` of ``pairs`` were measured.
    """
    vectors = views.table(spark, sf_dir, "embeddings")
    asked = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    known = vectors.select(F.col("vec_id").alias("known_id"), F.col("embedding").alias("vec"))
    found, compared = vector_index.build(known, k=NEIGHBOURS).search(asked, NEIGHBOURS)
    exact = materialize(retrieval.nearest(asked, known, NEIGHBOURS).select("query_id", "known_id", F.lit(True).alias("exact")), "exact")
    judged = materialize(found.join(exact, ["query_id", "known_id"], "left").fillna(False, ["exact"]), "judged")
    recall = judged.filter("exact").count() / max(1, exact.count())
    return judged.select(
        "query_id", "rank", "known_id", F.round("distance", 6).alias("distance"), "exact", F.lit(recall).alias("recall"),
        F.lit(compared).cast("long").alias("compared"), F.lit(asked.count() * known.count()).cast("long").alias("pairs"),
    )


def _rag_requests(spark, sf_dir, **how):
    profile = Profile(
        prompts={**PROMPTS, "system": SYSTEM}, provider=None,
        known=KnownPairs(None, None, EXAMPLES, USER_REQUEST, ASSISTANT_RESPONSE),
    )
    job = Translation(profile, "/", "/out", known=_numbered_pairs(spark, sf_dir), **how)
    docs = views.documents(spark, sf_dir, busy=True).select(F.col("doc_id").cast("string").alias("path"), "text")
    asked = requests_for(docs, job)
    chat = requests.assemble_messages(F.col("user"), F.col("system"), F.col("history"))
    return _messages(asked.withColumn("doc_id", F.col("path").cast("long")), ["doc_id"], chat)


@query
def rag_requests(spark, sf_dir):
    """Every document as a request with its nearest known pairs before it."""
    return _rag_requests(spark, sf_dir)


@query
def rag_requests_large(spark, sf_dir):
    """The same requests by the way taken when the known pairs are too large to send."""
    return _rag_requests(spark, sf_dir, max_local_bytes=0)


# --- inference ------------------------------------------------------------


def echo(user, system, history):
    return user


def refuse_toxic(user, system, history):
    if system == "toxic":
        raise ValueError("refused")
    return "Re: " + user


@query
def batch_infer(spark, sf_dir):
    asked = views.documents(spark, sf_dir).select("doc_id", F.col("text").alias("user"))
    return inference.ask(asked, inference.FunctionProvider(echo), ["doc_id"]).select("doc_id", "response", "error")


def _refused(spark, sf_dir):
    # A document counts as toxic if any of its labels says so.
    toxic = views.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    asked = views.documents(spark, sf_dir).join(toxic, "doc_id", "left").select(
        "doc_id", "source", F.col("text").alias("user"), F.when(F.col("toxic") == 1, "toxic").alias("system")
    )
    return inference.ask(asked, inference.FunctionProvider(refuse_toxic, threads=4, timeout_sec=60), ["doc_id", "source"])


@query
def batch_infer_errors(spark, sf_dir):
    return _refused(spark, sf_dir).select("doc_id", "response", "error")


class Labelled(inference.Provider):
    """Replies that tell which run gave them; the label is no part of what a reply depends on."""

    def __init__(self, label: str):
        self.label = label

    def identity(self):
        return "labelled"

    def reply(self, user, system, history):
        return f"{self.label}: {user}"


@query
def batch_infer_resumed(spark, sf_dir):
    """Every other document is asked about, then all of them: the second run asks for the rest only."""
    store = scratch_dir(spark, "replies")
    asked = views.documents(spark, sf_dir).select("doc_id", F.col("text").alias("user"))
    first = inference.ask_resumable(asked.filter("doc_id % 2 = 0"), Labelled("first"), ["doc_id"], store)
    first.write.format("noop").mode("overwrite").save()
    return inference.ask_resumable(asked, Labelled("second"), ["doc_id"], store, slice_requests=5_000).select("doc_id", "response", "error")


def stall(user, system, history):
    if system == "slow":
        time.sleep(6)
    return echo(user, system, history)


@query
def batch_infer_timeouts(spark, sf_dir):
    asked = views.documents(spark, sf_dir).select("doc_id", F.col("text").alias("user"), F.when(F.col("doc_id") % 97 == 3, "slow").alias("system"))
    return inference.ask(asked, inference.FunctionProvider(stall, threads=8, timeout_sec=2), ["doc_id"]).select("doc_id", "response", "error")


@query
def reply_validity(spark, sf_dir):
    blanked = views.replies(spark, sf_dir).select(
        "doc_id", F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("reply")).alias("response")
    )
    return inference.check_reply(blanked).select("doc_id", "error")


@query
def outcome_report(spark, sf_dir):
    return assembling.outcome_report(reading.with_status(_refused(spark, sf_dir)), ["source"])


# --- assembly and whole jobs ----------------------------------------------


@query
def concat_replies(spark, sf_dir):
    """Batches of every document, replied to by echo, joined in order again."""
    rows = _batches(spark, sf_dir).select("doc_id", F.struct("batch_ix", "text").alias("r"))
    return rows.groupBy("doc_id").agg(
        assembling.concat_in_order(F.collect_list("r"), "batch_ix", "text").alias("methods")
    )


@query
def splice_methods(spark, sf_dir):
    third, mark = F.col("doc_id") % 3, F.lit(assembling.METHODS_MARK)
    skeleton = F.concat(
        F.lit("class "), "source",
        F.when(third == 0, F.concat(F.lit(" { "), mark, F.lit(" }")))
        .when(third == 1, F.concat(F.lit(" { "), mark, F.lit(" | "), mark, F.lit(" }")))
        .otherwise(" { }"),
    )
    return views.documents(spark, sf_dir).select("doc_id", assembling.splice_methods(skeleton, F.col("text")).alias("text"))


def _job(prompts, **target):
    profile = Profile(prompts=prompts, provider=None, limit=WHOLE_LIMIT, directives_to_comments=True, **target)
    return Translation(profile, views.ROOT, "/out")


@query
def migrate_single_file(spark, sf_dir):
    job = _job(PROMPTS, extension=".gd", spaces_to_tabs=True, snake_case_names=True, lower_folders=True)
    return to_single_file(views.sources(spark, sf_dir, busy=True).select("path", "text"), job)


@query
def migrate_two_files(spark, sf_dir):
    job = _job(TWO_FILE_PROMPTS, header_extension=".h", implementation_extension=".cpp", camel_case_names=True)
    return to_two_files(views.sources(spark, sf_dir, busy=True).select("path", "text"), job)


@query
def migrate_mixed(spark, sf_dir):
    """One, two or no files by strategy, in one pass."""
    job = _job(TWO_FILE_PROMPTS, extension=".gd", header_extension=".h", implementation_extension=".cpp", camel_case_names=True)
    strategy = F.when(F.col("doc_id") % 5 == 4, "Nobody").when(F.col("doc_id") % 2 == 0, SINGLE_FILE).otherwise(TWO_FILES)
    return to_each(views.sources(spark, sf_dir, busy=True).select("path", "text", strategy.alias("strategy")), job)


def annotate(user, system, history):
    if len(user) % 5 == 0:
        raise ValueError("no fives")
    return f"```cs\n// {system}\n{user}\n// {len(history)}\n```"


@query
def migrate_project(spark, sf_dir):
    """A whole job on a project tree: ignored, empty, unrouted, colliding and refused files, and what was written."""
    root, out = scratch_dir(spark, "project"), scratch_dir(spark, "migrated")
    tenth = F.floor(F.col("doc_id") / 10).cast("string")
    name = (
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("FooBar"), tenth)).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("foo_bar"), tenth))
        .otherwise(F.concat(F.lit("Doc"), F.col("doc_id").cast("string")))
    )
    folder = F.when(F.col("doc_id") % 7 == 0, "Library/").otherwise("Assets/")
    ending = F.when(F.col("doc_id") % 11 == 0, ".txt").otherwise(".cs")
    content = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.col("text"))
    tree_files = views.documents(spark, sf_dir).select(F.concat(folder, name, ending).alias("dest_path"), content.alias("content"))
    settings = spark.createDataFrame([("ProjectSettings/x.asset", "")], "dest_path string, content string")
    materialize(sink.write_files(tree_files.union(settings).withColumn("dest_path", F.concat(F.lit(root + "/"), "dest_path"))), "project-log")
    pairs_at = scratch_dir(spark, "known") + ".parquet"
    views.pairs(spark, sf_dir).select("source", "target").write.parquet(pairs_at)
    profile = Profile(
        prompts={"system": SYSTEM, "full": "${CODE}"}, provider=None, extension=".gd", snake_case_names=True, ignore=["Library"], strategies={".cs": SINGLE_FILE},
        known=KnownPairs(None, None, EXAMPLES, USER_REQUEST, ASSISTANT_RESPONSE),
    )
    report = jobs.run(
        spark, profile, root, out, provider=inference.FunctionProvider(annotate), counter=CharCounter(), embedder=TrigramEmbedder(), pairs_path=pairs_at
    )
    written = reading.decode_text(tree.read_contents(tree.list_tree(spark, out))).select(F.col("path").alias("dest_path"), F.col("text").alias("content"))
    inside = lambda c, top: F.substring(c, len(top) + 2, F.length(c))
    # Contents are estimated by the listing they were read from; without the hint all of them would be sent through the driver.
    joined = report.join(written.withColumnRenamed("dest_path", "_at").hint("merge"), F.col("dest_path") == F.col("_at"), "left")
    return joined.select(
        inside(F.col("path"), root).alias("path"), inside(F.col("dest_path"), out).alias("dest_path"), "status", "error",
        F.when(F.col("status") == "ok", F.col("content")).alias("content"),
    )
