"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by their set of sources (the membership
pattern); token capacity then flows from patterns to source quotas. Every further copy of a pattern costs more
than the one before (convex repetition costs), so nothing repeats while unrepeated text can still fill a quota.
The flow fixes how many tokens each pattern gives; which documents give them is decided by a seeded order, found
with prefix histograms of a keyed digest, so no pattern is ever sorted or collected as a whole.

Sizes and targets of sources are tables, whatever the number of sources. A pattern of one source that no other pattern shares
gives its source's target, which needs no flow; only patterns that overlap, and those of the sources they share, are routed on the driver.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import numbered
from glyphmill.scratch import materialize

#: Overlapping patterns are routed on the driver; more than these are refused rather than cut.
MAX_PATTERNS = 200_000
#: Hex digits of a digest that one histogram level resolves.
_LEVEL = 3


@dataclass(frozen=True)
class Weights:
    """Shares of sources in code point order, null last: ``weights`` repeat, ``halves`` halves of all tokens are asked for."""

    weights: tuple[int, ...] = (5, 2, 1)
    halves: int = 3
    max_copies: int = 2

    def targets(self, sizes: dict[str | None, int], total: int | None = None) -> dict[str | None, float]:
        """Tokens asked of each source: by weight, at most ``max_copies`` times its size, the excess reshared.

        ``total``: tokens of all documents, less than the sum of ``sizes`` where sources overlap.
        """
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: self.weights[i % len(self.weights)] for i, s in enumerate(order)}
        cap = {s: self.max_copies * sizes[s] for s in order}
        left, free = self.halves * (sum(sizes.values()) if total is None else total), set(order)
        while True:
            shared = sum(weight[s] for s in free)
            above = {s for s in free if weight[s] * left > 2 * cap[s] * shared}
            if not above:
                return {s: weight[s] * left / (2 * shared) if s in free else float(cap[s]) for s in order}
            left -= 2 * sum(cap[s] for s in above)
            free -= above


def route(patterns: dict[str, tuple[int, tuple]], quotas: dict, max_copies: int) -> dict[tuple[str, object], int]:
    """Tokens sent from each pattern to each of its sources: a flow of largest value and least cost.

    ``patterns``: key to (tokens, sources). The k-th copy of a pattern costs k squared a token. Any path into the flow
    pays only for the copy it starts with, so filling the copies in order of cost, each to a maximal flow over
    the graph that earlier copies left, yields the least cost.
    """
    flow: dict[tuple[str, object], int] = defaultdict(int)
    to = {p: [s for s in sources if quotas.get(s, 0) > 0] for p, (_, sources) in patterns.items()}
    back: dict[object, set[str]] = defaultdict(set)
    room = dict(quotas)
    for _ in range(max_copies):
        supply = {p: tokens for p, (tokens, _) in patterns.items()}
        for p in supply:
            while supply[p]:
                # The shortest way from the pattern to a source with room; flow may be taken back on the way.
                came, queue, ends = {p: None}, deque([p]), []
                seen: dict[object, str] = {}
                while queue and not ends:
                    at = queue.popleft()
                    for s in to[at]:
                        if s in seen:
                            continue
                        seen[s] = at
                        if room[s]:
                            ends.append(s)
                            break
                        for other in back[s]:
                            if other not in came:
                                came[other] = s
                                queue.append(other)
                if not ends:
                    break
                (end,) = ends
                steps, s = [], end
                while True:
                    at = seen[s]
                    steps.append((at, s, 1))
                    if at == p:
                        break
                    s = came[at]
                    steps.append((at, s, -1))
                n = min([supply[p], room[end], *(flow[a, x] for a, x, sign in steps if sign < 0)])
                for a, x, sign in steps:
                    flow[a, x] += sign * n
                    (back[x].add if flow[a, x] else back[x].discard)(a)
                supply[p] -= n
                room[end] -= n
    return dict(flow)


def pattern_key(sources: Column) -> Column:
    """A string that names a set of sources; null is a source like any other."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def draw(seed: int, ident: Column, text: Column | None = None) -> Column:
    """A document's place in the seeded order: 32 hex digits, equal for equal ids; by its text where the id is null."""
    other = F.lit("null") if text is None else F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), other)))


def source_targets(sizes: DataFrame, weights: Weights, total: int) -> DataFrame:
    """``source, source_size, target`` for ``source, size``, as ``Weights.targets`` has it, for any number of sources.

    The level to which sources fill is found by rounds over the table: each sums what those below it leave to the others.
    """
    order = [F.col("source").isNull(), "source"]
    ranked = numbered(sizes, order, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights.weights]), (F.col("rank") % len(weights.weights) + 1).cast("int"))
    rows = materialize(ranked.select("source", "size", weight.cast("long").alias("weight")), "mix-sources")
    whole = lambda n: F.lit(Decimal(int(n))).cast("decimal(20,0)")
    left, shared, full = weights.halves * total, rows.agg(F.sum("weight")).first()[0] or 0, 0
    while True:
        above = F.col("weight").cast("decimal(10,0)") * whole(left) > (2 * weights.max_copies * F.col("size")).cast("decimal(19,0)") * F.lit(Decimal(shared)).cast("decimal(18,0)")
        capped = rows.select("weight", "size", above.alias("above"))
        n, caps, free = capped.agg(
            F.count_if("above"), F.sum(F.when(F.col("above"), F.col("size")).otherwise(0)), F.sum(F.when(F.col("above"), 0).otherwise(F.col("weight")))
        ).first()
        if n == full:
            level = (F.col("weight") * left).cast("double") / float(2 * shared or 1)
            return rows.select("source", F.col("size").alias("source_size"), F.when(above, (weights.max_copies * F.col("size")).cast("double")).otherwise(level).alias("target"))
        left, shared, full = weights.halves * total - 2 * weights.max_copies * caps, free, n


def _entangled(patterns: DataFrame, targets: DataFrame, weights: Weights) -> tuple[DataFrame, list[tuple]]:
    """The keys of patterns whose sources overlap, and what the flow lets each give: ``key, whole, rest``."""
    sources = patterns.select("key", "size", F.explode(F.array_distinct("sources")).alias("source"), (F.size(F.array_distinct("sources")) > 1).alias("several"))
    shared = sources.filter("several").select(F.col("source").alias("_source")).distinct()
    keys = materialize(sources.join(shared, F.col("source").eqNullSafe(F.col("_source")), "left_semi").select("key").distinct(), "mix-overlaps")
    if keys.isEmpty():
        return keys, []
    found = patterns.join(keys, "key").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} overlapping membership patterns")
    supply = {r["key"]: (r["size"], tuple(dict.fromkeys(r["sources"]))) for r in found}
    own = sources.join(keys, "key").select(F.col("source").alias("_source")).distinct()
    quotas = {r["source"]: round(r["target"]) for r in targets.join(own, F.col("source").eqNullSafe(F.col("_source")), "left_semi").collect()}
    given: dict[str, int] = defaultdict(int)
    for (p, _), n in route(supply, quotas, weights.max_copies).items():
        given[p] += n
    return keys, [(p, *divmod(given[p], tokens)) if tokens else (p, 0, 0) for p, (tokens, _) in sorted(supply.items())]


def plan(sized: DataFrame, weights: Weights) -> tuple[DataFrame, DataFrame]:
    """What each pattern gives, from written ``key, sources, draw, size``.

    Returns one row per pattern (``key, whole, cut``: a document is taken ``whole`` times, and once more if its draw
    is not above ``cut``), and ``source, source_size, target`` for the sources.
    """
    spark = sized.sparkSession
    patterns = materialize(sized.groupBy("key").agg(F.sum("size").alias("size"), F.any_value("sources").alias("sources")), "mix-patterns")
    total = patterns.agg(F.sum("size")).first()[0] or 0
    sizes = patterns.select(F.explode(F.array_distinct("sources")).alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    targets = materialize(source_targets(sizes, weights, total), "mix-targets")
    keys, routed = _entangled(patterns, targets, weights)
    alone = patterns.join(keys, "key", "left_anti").withColumn("_source", F.get("sources", F.lit(0))).join(targets, F.col("source").eqNullSafe(F.col("_source")) & (F.size("sources") > 0), "left")
    asked = F.coalesce(F.bround("target").cast("long"), F.lit(0))
    share = lambda how: F.when(F.col("size") > 0, F.expr(f"_asked {how} size")).otherwise(0).cast("long")
    budget = alone.withColumn("_asked", asked).select("key", share("div").alias("whole"), share("%").alias("rest"))
    # Written, so that a join knows how large it is.
    budget = materialize(budget.unionByName(spark.createDataFrame(routed, "key string, whole long, rest long")), "mix-budget")
    return _cuts(sized, budget), targets


def _cuts(sized: DataFrame, budget: DataFrame) -> DataFrame:
    """Adds ``cut``: the draw up to which documents, in order of draw, come nearest to ``rest`` tokens.

    Rows are added up by key and bin before they meet the budget, and later meet it by key and bin, so a key that holds most rows is spread
    over its bins.
    """
    prefix = lambda k: F.substring("draw", 1, _LEVEL * k)
    earlier = lambda by: F.coalesce(F.sum("size").over(W.partitionBy("key").orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = budget.withColumn("at", F.lit(""))
    for k in (1, 2):
        if k == 1:
            counts = sized.groupBy("key", prefix(1).alias("bin")).agg(F.sum("size").alias("size")).join(level.filter("rest > 0").select("key", "rest"), "key")
        else:
            inside = sized.withColumn("at", prefix(k - 1)).join(level.filter("rest > 0").select("key", "at", "rest"), ["key", "at"])
            counts = inside.groupBy("key", "rest", prefix(k).alias("bin")).agg(F.sum("size").alias("size"))
        edge = counts.withColumn("below", earlier("bin")).filter("below < rest and below + size >= rest")
        edge = edge.select("key", F.col("bin").alias("_at"), (F.col("rest") - F.col("below")).alias("_rest"))
        level = materialize(
            level.select("key", "whole").join(edge, "key", "left").select("key", "whole", F.coalesce("_at", F.lit("")).alias("at"), F.coalesce("_rest", F.lit(0)).alias("rest")),
            "mix-level",
        )
    inside = sized.withColumn("at", prefix(2)).join(level.filter("rest > 0").select("key", "at", "rest"), ["key", "at"])
    peers = inside.groupBy("key", "rest", "draw").agg(F.sum("size").alias("size"))
    last = peers.withColumn("below", earlier("draw")).filter("2 * below + size <= 2 * rest").groupBy("key").agg(F.max("draw").alias("last"))
    return level.join(last, "key", "left").select("key", "whole", F.coalesce("last", "at").alias("cut"))


def copies(draw: Column, given: Column) -> Column:
    """Times that a document is taken; ``given`` has ``whole`` and ``cut`` of its pattern's row of ``plan``."""
    return given["whole"] + F.when(draw <= given["cut"], 1).otherwise(0)


def mix(docs: DataFrame, sources: Column, size: Column, weights: Weights, seed: int = 0, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; columns stay as they are.

    Null sources form a source of their own; documents without tokens are never taken a partial time; repeated ids share
    their draw and are taken together, rows without an id are drawn by their text; an empty table gives an empty table. The same rows and seed give the same mix.
    """
    place = draw(seed, F.col(ident), F.col(text))
    sized = materialize(docs.select(pattern_key(sources).alias("key"), sources.alias("sources"), place.alias("draw"), size.alias("size")), "mix-sizes")
    cuts = materialize(plan(sized, weights)[0], "mix-cuts").select(F.col("key").alias("_mix_key"), F.struct("whole", "cut").alias("_mix"))
    taken = docs.join(cuts, pattern_key(sources) == F.col("_mix_key")).withColumn("_copies", copies(place, F.col("_mix")).cast("int"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).filter("_copies > 0").select(*[docs[c] for c in docs.columns])
