"""The two ways of translating a corpus, as one plan each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import paths
from glyphmill.functions import text as T
from glyphmill.functions.embedding import Embedder, TrigramEmbedder
from glyphmill.functions.packing import SEPARATOR
from glyphmill.functions.tokens import CharCounter
from glyphmill.operators.assembling import gather_replies, splice_methods
from glyphmill.operators.inference import IdentityProvider, Provider, ask, ask_resumable
from glyphmill.operators.reading import FAILED, OK
from glyphmill.operators.requests import HISTORY, flatten_messages, render_prompt
from glyphmill.operators.retrieval import MAX_LOCAL_BYTES, attach_history
from glyphmill.operators.segmenting import plan_pieces
from glyphmill.plans.profiles import SINGLE_FILE, TWO_FILES, Profile

PIECE_KEYS = ["path", "kind", "piece_ix"]


@dataclass
class Translation:
    """Everything a strategy works with."""

    profile: Profile
    source_root: str
    destination_root: str
    provider: Provider = field(default_factory=IdentityProvider)
    counter: object = field(default_factory=CharCounter)
    known: DataFrame | None = None
    embedder: Embedder = field(default_factory=TrigramEmbedder)
    reply_store: str | None = None
    #: Known pairs, with their vectors, that are sent to the tasks; larger ones are joined.
    max_local_bytes: int = MAX_LOCAL_BYTES

    def destination(self, extension: str) -> Column:
        p = self.profile
        return paths.destination_path(
            F.col("path"), self.source_root, self.destination_root, extension,
            lower_folders=p.lower_folders, camel_case=p.camel_case_names, snake_case=p.snake_case_names,
        )

    def indent(self, c: Column) -> Column:
        return T.convert_indent(c, self.profile.tabs_to_spaces, self.profile.spaces_to_tabs)


def requests_for(sources: DataFrame, job: Translation) -> DataFrame:
    """All requests of a corpus: pieces of every file with prompt, system rules and history.

    ``sources`` has ``path``, ``text`` and, for files that could not be read, ``error``.
    """
    p = job.profile
    if p.directives_to_comments:
        sources = sources.withColumn("text", T.directives_to_comments(F.col("text")))
    pieces = plan_pieces(sources, job.counter, p.limit)
    pieces = pieces.withColumn("piece_ix", F.coalesce("piece_ix", F.lit(-1)))
    if p.known is not None:
        pieces = attach_history(
            pieces, job.known, job.embedder, p.known.count, p.known.user_request, p.known.assistant_response,
            max_local_bytes=job.max_local_bytes,
        )
    asked = render_prompt(pieces, p.prompts).withColumn("system", F.lit(p.prompts.get("system")).cast("string"))
    template = p.provider_settings.get("prompt_template")
    if template:  # a completion model gets one flat text
        history = F.col("history") if "history" in asked.columns else None
        flat = flatten_messages(template, F.col("user"), F.col("system"), history)
        asked = asked.withColumns({"user": flat, "system": F.lit(None).cast("string"), "history": F.array().cast(HISTORY)})
    return asked


def _replies(sources: DataFrame, job: Translation, keys: list[str] = PIECE_KEYS) -> DataFrame:
    requests = requests_for(sources, job)
    if job.reply_store:
        return ask_resumable(requests, job.provider, keys, job.reply_store)
    return ask(requests, job.provider, keys)


_FILE = "array<struct<dest_path:string,content:string>>"


def _files(*files: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(d.alias("dest_path"), c.alias("content")) for d, c in files]).cast(_FILE)


def _outputs(gathered: DataFrame, files: Column) -> DataFrame:
    """One row per output of a file that went well, one row without content for one that failed."""
    failed = F.col("error").isNotNull()
    bad = F.array(F.struct(F.get(files, F.lit(0))["dest_path"].alias("dest_path"), F.lit(None).alias("content"))).cast(_FILE)
    return gathered.select("path", F.when(failed, FAILED).otherwise(OK).alias("status"), "error", F.inline_outer(F.when(failed, bad).otherwise(files)))


def _single(job: Translation) -> Column:
    """The output of a gathered file whose replies have ``code``."""
    text = F.when(F.col("_is_full"), F.col("code_full")).otherwise(splice_methods(F.col("code_class"), F.col("code_methods")))
    return _files((job.destination(job.profile.extension), job.indent(text)))


def _header_and_body(job: Translation) -> Column:
    """The outputs of a gathered file whose replies have ``header`` and ``body``."""
    full = F.col("_is_full")
    header = F.when(full, F.col("header_full")).otherwise(splice_methods(F.col("header_class"), F.col("header_methods")))
    body = F.when(full, F.col("body_full")).otherwise(F.concat(F.col("body_class"), F.lit(SEPARATOR), F.col("body_methods")))
    return _files((job.destination(job.profile.header_extension), job.indent(header)), (job.destination(job.profile.implementation_extension), job.indent(body)))


def to_single_file(sources: DataFrame, job: Translation, extract: Callable[[Column], Column] = T.first_code_block) -> DataFrame:
    """Each source becomes one file: ``path, status, error, dest_path, content``; ``extract`` takes its code from a reply."""
    replies = _replies(sources, job).withColumn("code", extract(F.col("response")))
    return _outputs(gather_replies(replies, ["code"], ["path"]), _single(job))


def to_two_files(sources: DataFrame, job: Translation, extract: Callable[[Column], Column] = T.header_and_implementation) -> DataFrame:
    """Each source becomes a header and an implementation file; ``extract`` gives both of a reply, as a struct."""
    replies = _replies(sources, job).withColumn("_split", extract(F.col("response")))
    replies = replies.withColumn("header", F.col("_split.header")).withColumn("body", F.col("_split.implementation"))
    return _outputs(gather_replies(replies, ["header", "body"], ["path"]), _header_and_body(job))


def to_each(sources: DataFrame, job: Translation) -> DataFrame:
    """Each source by its ``strategy``, one file or two, in one pass: one read, one round of questions, one gathering.

    A source whose strategy is neither of the two fails without being asked about; other sources are not touched by it.
    """
    one, two = F.col("strategy") == SINGLE_FILE, F.col("strategy") == TWO_FILES
    unknown = F.when(~F.coalesce(one | two, F.lit(False)), F.format_string("strategy '%s' is not known", "strategy"))
    earlier = F.col("error") if "error" in sources.columns else F.lit(None).cast("string")
    replies = _replies(sources.withColumn("error", F.coalesce(unknown, earlier)), job, [*PIECE_KEYS, "strategy"])
    response = F.col("response")
    replies = replies.withColumns({"code": F.when(one, T.first_code_block(response)), "_split": F.when(two, T.header_and_implementation(response))})
    replies = replies.withColumns({"header": F.col("_split.header"), "body": F.col("_split.implementation")})
    gathered = gather_replies(replies, ["code", "header", "body"], ["path", "strategy"])
    return _outputs(gathered, F.when(one, _single(job)).when(two, _header_and_body(job)))


Strategy = Callable[[DataFrame, Translation], DataFrame]
STRATEGIES: dict[str, Strategy] = {SINGLE_FILE: to_single_file, TWO_FILES: to_two_files}


def register_strategy(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


def main_extension(profile: Profile, strategy: str) -> str:
    return profile.header_extension if strategy == TWO_FILES else profile.extension


def translate(sources: DataFrame, job: Translation) -> DataFrame:
    """Every source by the strategy its ``strategy`` column names.

    One strategy is applied to all. Of several, the two built-in ones and unknown names go through one pass; a
    strategy registered by a caller is a function of its sources, and has a branch of its own.
    """
    routes = sorted({s for s in job.profile.strategies.values() if s})
    if len(routes) == 1 and routes[0] in STRATEGIES:
        return STRATEGIES[routes[0]](sources.drop("strategy"), job)
    builtin = {SINGLE_FILE: to_single_file, TWO_FILES: to_two_files}
    own = [name for name in routes if name in STRATEGIES and STRATEGIES[name] is not builtin.get(name)]
    out = None
    if len(own) < len(routes):
        out = to_each(sources.filter(~F.col("strategy").isin(own)) if own else sources, job)
    for name in own:
        part = STRATEGIES[name](sources.filter(F.col("strategy") == name).drop("strategy"), job)
        out = part if out is None else out.unionByName(part)
    return out
