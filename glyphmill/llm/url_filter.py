"""URL filtering: domain rules first, then gradient-boosted trees on lexical features of the address.

Everything about an address is worked out by column expressions; Spark's own trees are trained on labelled
addresses and judge those that no rule covers. What a suffix or domain is known for is taken, for the rows that the trees see, from rows of
other folds, so that no row carries its own label. A fifth of the hosts is held out; the score from which an address is blocked is the
least at which few of their harmless addresses would be. An address whose suffix has no label is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.rows import let
from glyphmill.scratch import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEXICAL = (
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "host_hyphens", "host_labels", "entropy", "params", "query_length", "fragment",
)
_SUFFIX = ("suffix_rate", "suffix_seen", "domain_rate", "domain_seen")
FEATURES = [*_LEXICAL, *_SUFFIX]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered; empty if there is no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``where``: a domain and a path, as ``net/es/``; it holds for the domain and all below it. ``verdict``: allow or block."""

    where: str
    verdict: str

    def covers(self, host: Column, path: Column) -> Column:
        domain, _, below = self.where.partition("/")
        return ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + below)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that covers an address, as a struct of ``where`` and ``verdict``; null if none does."""
    made = [F.when(r.covers(host, path), F.struct(F.lit(r.where).alias("where"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: -len(r.where))]
    return F.coalesce(*made) if made else F.lit(None).cast("struct<where:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits a character, from the counts of the distinct characters."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c))) / F.length(text)
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda h, c: h - F.when(c == "", 0.0).otherwise(let(share(c), lambda p: p * F.log2(p))))
    return F.when(F.length(text) > 0, bits).otherwise(0.0)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the struct ``_url``: host, path, the two suffixes and the lexical features of an address (null: empty)."""
    address = F.coalesce(F.col(url), F.lit(""))
    parts = df.withColumn("_url", F.struct(address.alias("url"), host_of(address).alias("host"), path_of(address).alias("path")))
    host, path, whole = F.col("_url.host"), F.col("_url.path"), F.col("_url.url")
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    values = {
        "url_length": F.length(whole), "host_length": F.length(host), "path_length": F.length(path),
        "depth": F.regexp_count(path, F.lit("[^/]+")), "digit_ratio": F.regexp_count(whole, F.lit("[0-9]")) / F.greatest(F.length(whole), F.lit(1)),
        "host_digits": F.regexp_count(host, F.lit("[0-9]")), "host_hyphens": F.regexp_count(host, F.lit("-")), "host_labels": F.regexp_count(host, F.lit("[^.]+")),
        "entropy": _entropy(whole), "params": F.regexp_count(query, F.lit("[^&]+")), "query_length": F.length(query), "fragment": F.instr(whole, "#") > 0,
    }
    return parts.withColumn("_url", F.struct(
        host.alias("host"), path.alias("path"), F.substring_index(host, ".", -1).alias("suffix"), F.substring_index(host, ".", -2).alias("domain"),
        *[values[f].cast("double").alias(f) for f in _LEXICAL],
    ))


@dataclass
class UrlModel:
    """Statistics of suffixes and domains, and the trees; ``trees`` is None where the labels had one class only, ``only``.

    ``at`` is the score from which an address is blocked; ``false_blocks`` and ``catches`` are the shares of harmless and of bad held-out
    addresses that it blocks, None where none was held out.
    """

    suffixes: DataFrame
    domains: DataFrame
    trees: GBTClassificationModel | None
    only: float
    at: float = 0.5
    false_blocks: float | None = None
    catches: float | None = None

    def judge(self, df: DataFrame) -> DataFrame:
        """Adds ``block_score`` (0 to 1) and ``known`` (the suffix has labels) to rows with ``_url``."""
        full = self._features(df).withColumn("known", F.col("suffix_seen") > 0)
        if self.trees is None:
            return full.withColumn("block_score", F.lit(self.only)).drop(*_SUFFIX)
        return _scored(self.trees, full).drop(*_SUFFIX)

    def _features(self, df: DataFrame) -> DataFrame:
        for found, key in ((self.suffixes, "suffix"), (self.domains, "domain")):
            df = df.join(found.select(F.col(key).alias("_key"), F.col("blocked").alias("_blocked"), F.col("n").alias("_n")), F.col(f"_url.{key}") == F.col("_key"), "left")
            df = _rated(df, key).drop("_key", "_blocked", "_n")
        return df


def _rated(df: DataFrame, key: str) -> DataFrame:
    """Rate, smoothed towards one half by two addresses, and weight of ``_blocked`` of ``_n`` addresses; null counts as none."""
    n, blocked = F.coalesce("_n", F.lit(0)), F.coalesce("_blocked", F.lit(0.0))
    return df.withColumns({f"{key}_rate": (blocked + 1) / (n + 2), f"{key}_seen": F.log2(n + 1)})


def _scored(trees: GBTClassificationModel, full: DataFrame) -> DataFrame:
    scored = trees.transform(_assembled(full))
    return scored.withColumn("block_score", vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_prediction")


def _assembled(df: DataFrame) -> DataFrame:
    lifted = df.withColumns({f"_f_{f}": F.col(f"_url.{f}") for f in _LEXICAL})
    inputs = [f"_f_{f}" for f in _LEXICAL] + list(_SUFFIX)
    return VectorAssembler(inputCols=inputs, outputCol="_features").transform(lifted).drop(*[f"_f_{f}" for f in _LEXICAL])


def out_of_fold(rows: DataFrame, stats: dict[str, DataFrame]) -> DataFrame:
    """Rates for labelled ``rows`` (``_url, fold``) from the rows of all other folds; ``stats``: key to ``key, fold, blocked, n``."""
    for key, found in stats.items():
        whole = found.groupBy(key).agg(F.sum("blocked").alias("_all"), F.sum("n").alias("_all_n"))
        rest = found.join(whole, key).select(F.col(key).alias("_key"), F.col("fold").alias("_fold"), (F.col("_all") - F.col("blocked")).alias("_blocked"), (F.col("_all_n") - F.col("n")).alias("_n"))
        rows = rows.join(rest, (F.col(f"_url.{key}") == F.col("_key")) & (F.col("fold") == F.col("_fold")), "left")
        rows = _rated(rows, key).drop("_key", "_fold", "_blocked", "_n")
    return rows


def least_score(scores: list[tuple[float, float]], most_false: float) -> tuple[float, float | None, float | None]:
    """From ``(score, label)``: the least score above which at most ``most_false`` of the harmless lie; shares of harmless and bad above it."""
    good, bad = sorted(s for s, b in scores if not b), [s for s, b in scores if b]
    if not good:
        return 0.5, None, None
    at = good[max(0, len(good) - 1 - int(most_false * len(good)))]
    return at, sum(s > at for s in good) / len(good), sum(s > at for s in bad) / len(bad) if bad else None


def _nth_from_top(scores: DataFrame, n: int) -> float:
    """The score that ``n`` others precede in descending order, by counts of ever narrower ranges: 1,024 rows a round."""
    low, high = scores.agg(F.min("block_score"), F.max("block_score")).first()
    while low < high:
        width = (high - low) / 1023 or high - low
        range_ = F.least(F.floor((F.col("block_score") - low) / width), F.lit(1023)).cast("int")
        counts = (
            scores.filter((F.col("block_score") >= low) & (F.col("block_score") <= high)).groupBy(range_.alias("r"))
            .agg(F.count("*").alias("n"), F.min("block_score").alias("low"), F.max("block_score").alias("high"))
        )
        for row in sorted(counts.collect(), key=lambda row: -row["r"]):
            if n < row["n"]:
                low, high = row["low"], row["high"]
                break
            n -= row["n"]
    return low


def least_score_of(judged: DataFrame, most_false: float) -> tuple[float, float | None, float | None]:
    """``least_score`` of a table with ``block_score`` and ``block``, of any size."""
    good = judged.filter("block = 0")
    n = good.count()
    if not n:
        return 0.5, None, None
    at = _nth_from_top(good, min(n - 1, int(most_false * n)))
    above, of_bad, bad_above = judged.agg(
        F.count_if((F.col("block") == 0) & (F.col("block_score") > at)), F.count_if(F.col("block") != 0), F.count_if((F.col("block") != 0) & (F.col("block_score") > at))
    ).first()
    return at, above / n, bad_above / of_bad if of_bad else None


def train(
    labelled: DataFrame, most: int | None = None, trees: int = 20, depth: int = 4, seed: int = 0, folds: int = 5, most_false: float = 0.01
) -> UrlModel:
    """Fit on ``url, block`` (0 or 1). Copies of an address count once, with the label that most of them have.

    Suffix and domain statistics use all addresses, the trees see all of four fifths of the hosts, and all of the other hosts set the
    score from which is blocked. A caller may ask for about ``most`` addresses on either side, chosen by a keyed digest of the address.
    """
    spark = labelled.sparkSession
    votes = labelled.filter("url is not null and block is not null").groupBy("url").agg(F.avg("block").alias("share"))
    place = lambda of, salt, n: F.pmod(F.xxhash64(F.lit(f"{seed} {salt}"), of), F.lit(n))
    lexed = lexical(votes.select("url", (F.col("share") > 0.5).cast("double").alias("block")))
    rows = materialize(lexed.select("url", "block", "_url", place(F.col("url"), "fold", folds).alias("fold"), (place(F.col("_url.host"), "held", 5) == 0).alias("held")), "urls")
    per_fold, stats = {}, []
    for key in ("suffix", "domain"):
        # Written, so that a join knows the size of the table.
        counted = rows.groupBy(F.col(f"_url.{key}").alias(key), "fold", "held").agg(F.sum("block").alias("blocked"), F.count("*").alias("n"))
        per_fold[key] = materialize(counted, f"url-{key}")
        stats.append(materialize(per_fold[key].groupBy(key).agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")), f"url-{key}"))
    n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0.0))).first()
    if blocked in (0, n):
        return UrlModel(*stats, None, 1.0 if n and blocked else 0.0)
    seen = {key: found.filter("not held").groupBy(key, "fold").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")) for key, found in per_fold.items()}
    held_n = rows.filter("held").count()
    chosen = lambda of, many: of if most is None else of.filter(place(F.col("url"), "sample", 1 << 30) < int(min(1.0, most / max(1, many)) * (1 << 30)))
    training = materialize(_assembled(out_of_fold(chosen(rows.filter("not held"), n - held_n), seen)).select("_features", "block"), "url-sample")
    if training.select("block").distinct().count() < 2:  # all of one class is held out: nothing to tell apart, and nothing speaks for blocking
        return UrlModel(*stats, None, 0.0)
    if spark.sparkContext.defaultParallelism < training.rdd.getNumPartitions():
        training = training.coalesce(spark.sparkContext.defaultParallelism)
    boosting = GBTClassifier(featuresCol="_features", labelCol="block", predictionCol="_prediction", maxIter=trees, maxDepth=depth, seed=seed)
    fitted = boosting.setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(training)
    # Held-out hosts are judged by what the others tell.
    others = [found.groupBy(key).agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")) for key, found in seen.items()]
    judged = _scored(fitted, UrlModel(*others, None, 0.0)._features(chosen(rows.filter("held"), held_n)))
    return UrlModel(*stats, fitted, 0.0, *least_score_of(materialize(judged.select("block_score", "block"), "url-scores"), most_false))


def decide(pages: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url", at: float | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    The longest rule decides; else an address is blocked whose score is above ``at`` (the model's own, if None) and whose suffix has labels. A null or unparseable url
    has an empty host and path, which no rule covers; equal urls get equal verdicts; an empty table gives none; columns with the new names are replaced, others,
    whatever their names, stay.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    # The caller's columns travel in a struct, apart from all names used here.
    scored = model.judge(lexical(pages.select(F.struct(*columns).alias("_page"), F.col(url).alias("_address")), "_address"))
    ruled = scored.withColumn("_rule", rule_of(F.col("_url.host"), F.col("_url.path"), rules))
    speaks = F.col("known") & (F.col("block_score") > (model.at if at is None else at))
    verdict = F.coalesce("_rule.verdict", F.when(speaks, "block").otherwise("allow"))
    return ruled.select(
        *[F.col(f"_page.{c}").alias(c) for c in columns], F.col("_url.host").alias("host"), F.col("_url.path").alias("path"), F.col("_rule.where").alias("rule"), verdict.alias("verdict"), "block_score"
    )
