"""A whole migration: scan, translate, write, report."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.embedding import Embedder, SentenceModelEmbedder
from glyphmill.functions.tokens import CharCounter, TiktokenCounter, TokenizerFileCounter
from glyphmill.operators.inference import IdentityProvider, Provider
from glyphmill.operators.reading import FAILED, SKIPPED, decode_text
from glyphmill.operators.routing import mark_collisions, missing_names, route_by_extension
from glyphmill.plans.profiles import PAIRS_BY_ENGINE, Profile, ProfileError, load_profile
from glyphmill.plans.translation import Translation, main_extension, translate
from glyphmill.scratch import cleaned, materialize
from glyphmill.sources.files import write_files
from glyphmill.sources.pairs import INDEXED, number_in_order, read_indexed_pairs
from glyphmill.sources.tree import _filesystem, list_tree, read_contents, top_level_names

log = logging.getLogger(__name__)

# What a project root must contain, and the exit codes of a job.
REQUIRED_NAMES = ["Assets", "ProjectSettings"]
EX_OK, EX_SOFTWARE, EX_IOERR, EX_CONFIG = 0, 70, 74, 78

PROVIDERS: dict[str, object] = {"TrivialLLM": lambda settings: IdentityProvider()}


def register_provider(name: str, factory) -> None:
    """``factory(settings) -> Provider`` for the provider name of a profile."""
    PROVIDERS[name] = factory


def provider_for(profile: Profile) -> Provider:
    if profile.provider not in PROVIDERS:
        raise ProfileError(f"no provider is registered for '{profile.provider}'")
    provider = PROVIDERS[profile.provider](profile.provider_settings)
    settings = profile.provider_settings
    if settings.get("num_workers"):
        provider.threads = settings["num_workers"]
    if settings.get("query_timeout_sec"):
        provider.timeout_sec = settings["query_timeout_sec"]
    return provider


def counter_for(profile: Profile):
    """Characters, unless the profile names a hosted model or a tokenizer file."""
    settings = profile.provider_settings
    if settings.get("tokenizer_file"):
        return TokenizerFileCounter(settings["tokenizer_file"])
    if settings.get("max_tokens") and settings.get("model"):
        return TiktokenCounter(settings["model"])
    if settings.get("context_length") or settings.get("max_tokens"):
        raise ProfileError("counting this profile's tokens needs 'model', 'tokenizer_file' or an explicit counter")
    return CharCounter()


def known_pairs(spark: SparkSession, profile: Profile, path: str | None = None) -> DataFrame | None:
    """The numbered pairs a profile asks for: from ``path``, or the list shipped for its engine."""
    if profile.known is None:
        return None
    if path:
        pairs = read_indexed_pairs(spark, path)
    else:
        shipped = PAIRS_BY_ENGINE.get(profile.known.engine, [])
        pairs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(shipped)], INDEXED)
    return number_in_order(pairs, ["pair_ix", "source", "target"]).drop("pair_ix")


def run(
    spark: SparkSession,
    profile: Profile | str,
    source: str,
    destination: str,
    *,
    provider: Provider | None = None,
    counter=None,
    embedder: Embedder | None = None,
    pairs_path: str | None = None,
    reply_store: str | None = None,
) -> DataFrame:
    """Migrate the tree at ``source`` into ``destination``.

    Returns ``path, dest_path, status, error``, one row per routed file: ``ok``, ``failed``,
    or ``skipped`` where another file has the same destination. A source that is no folder is refused, a destination is
    made where there is none. One bad file never stops the job. Scratch tables are removed at its end, but for the report.
    """
    if isinstance(profile, str):
        profile = load_profile(profile)
    with cleaned(spark) as keep:
        return keep(_run(spark, profile, source, destination, provider, counter, embedder, pairs_path, reply_store))


def check_source(source: str) -> None:
    from pyarrow import fs

    system, inner = _filesystem(source)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        raise NotADirectoryError(f"source '{source}' is not a folder")


def make_destination(destination: str) -> None:
    system, inner = _filesystem(destination)
    system.create_dir(inner, recursive=True)


def _run(spark, profile, source, destination, provider, counter, embedder, pairs_path, reply_store) -> DataFrame:
    check_source(source)
    make_destination(destination)
    missing = [r[0] for r in missing_names(top_level_names(spark, source), REQUIRED_NAMES).collect()]
    if missing:
        raise RuntimeError(f"'{source}' is not a project root: it has no {', '.join(sorted(missing))}")

    job = Translation(
        profile, source, destination,
        provider=provider or provider_for(profile),
        counter=counter or counter_for(profile),
        reply_store=reply_store,
    )
    if profile.known is not None:
        job.known = known_pairs(spark, profile, pairs_path)
        log.info("%d known pairs", job.known.count())
        job.embedder = embedder or SentenceModelEmbedder(profile.known.embedding)

    found, routed = Observation(), Observation()
    listed = list_tree(spark, source, ignored=profile.ignore).observe(found, F.count(F.lit(1)).alias("n"))
    files = route_by_extension(listed, profile.strategies)
    dest = F.lit(None).cast("string")
    for name in {s for s in profile.strategies.values() if s}:
        dest = F.when(F.col("strategy") == name, job.destination(main_extension(profile, name))).otherwise(dest)
    files = materialize(files.withColumn("dest_path", dest).observe(routed, F.count(F.lit(1)).alias("n")), "routed")
    log.info("found %d files, %d to migrate", found.get["n"], routed.get["n"])
    files = materialize(mark_collisions(files), "files")
    losers = files.filter(~F.col("wins")).select(
        "path", "dest_path", F.lit(SKIPPED).alias("status"),
        F.lit("another file has the same destination").alias("error"),
    )

    texts = decode_text(read_contents(files.filter("wins").select("path", "strategy", "length"))).drop("length")
    # Replies are dear, so what they became is computed once and kept.
    outputs = materialize(translate(texts, job), "outputs")
    written = materialize(write_files(outputs.filter(F.col("error").isNull())), "written")

    trouble = written.filter(F.col("error").isNotNull()).select("dest_path", F.col("error").alias("_write_error"))
    per_file = (
        outputs.select("path", "dest_path", "status", "error").join(trouble.hint("merge"), "dest_path", "left")  # all writes may have failed
        .withColumn("error", F.coalesce("error", "_write_error"))
        .groupBy("path")
        .agg(
            F.min_by("dest_path", F.when(F.col("dest_path").endswith(profile.header_extension or profile.extension), 0).otherwise(1)).alias("dest_path"),
            F.max("status").alias("status"), F.max("error").alias("error"),
        )
        .withColumn("status", F.when(F.col("error").isNotNull(), FAILED).otherwise(F.col("status")))
    )
    return per_file.unionByName(losers)


def run_to_exit_code(spark: SparkSession, profile: str, source: str, destination: str, **settings) -> int:
    """``run`` for scripts: logs the failures' count and returns an exit code."""
    try:
        loaded = load_profile(profile)
        check_source(source)
    except Exception as e:
        log.error("unable to start: %s", e)
        return EX_CONFIG
    try:
        make_destination(destination)
    except Exception as e:
        log.error("unable to create destination '%s': %s", destination, e)
        return EX_IOERR
    try:
        for row in run(spark, loaded, source, destination, **settings).groupBy("status").count().collect():
            log.info("%s: %d files", row["status"], row["count"])
        return EX_OK
    except Exception as e:
        log.error("unable to migrate: %s", e)
        return EX_SOFTWARE
