"""An inverted file over known vectors: neighbours from the cells around a query, with a recall that was measured.

Building. K-means on a bounded sample of the vectors (``sample``) gives the centres of the cells. Every row is put into the
cell of its nearest centre, and the table is stored by cell. Cells of more than ``block_rows`` rows are cut into blocks, so copies
of one vector, or a region that holds a third of all rows, are spread over tasks.

Probes. How many cells a query must look into depends on the vectors. It is worked out for a few known rows (``tests``), whose exact
neighbours are found among all rows: the fewest cells that hold the wanted share (``recall``) of them. Vectors without any structure
need many; the result is as good, the saving smaller.

Searching. A query goes to the cells it probes and meets each of their blocks once. A group of queries and a block of rows are
compared in one task, both of bounded size; k rows for each query leave it, and a window keeps the first k of them. Distances and ties are those of
``retrieval.nearest``; only a neighbour in a cell that wasn't probed can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators import retrieval
from glyphmill.scratch import materialize, scratch_dir, ship_package

METRICS = ("euclidean", "cosine")
#: Cells at most: their centres and sizes are sent to the tasks.
MOST_CELLS = 4096
#: Rows that k-means sees, and rows whose exact neighbours set the number of probes.
SAMPLE, TESTS = 20_000, 256
_VECTOR = "array<double>"


def _vector(column: Column, metric: str) -> Column:
    """The vector as doubles; for cosine at length one, where half the squared distance is one minus the cosine."""
    vec = column.cast(_VECTOR)
    if metric == "euclidean":
        return vec
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vec, lambda x: x / norm)).otherwise(vec)


def _order(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cells from the nearest centre to the farthest, for each vector."""
    return np.argsort((centres * centres).sum(axis=1)[None, :] - 2.0 * (vectors @ centres.T), axis=1, kind="stable")


def _probing(centres, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cells = _order(retrieval._matrix(pdf["vec"]), centres.value)[:, :probes]
                out = pdf.loc[pdf.index.repeat(cells.shape[1])].reset_index(drop=True)
                yield out.assign(cell=cells.reshape(-1).astype("int32"))

    return run


def _meeting(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"_q": [], "query_id": [], "known_id": [], "distance": []})
        ids, far = retrieval._ranked(retrieval._matrix(queries["vec"]), retrieval._matrix(rows["vec"]), rows["known_id"].to_numpy(), k)
        return pd.DataFrame({
            "_q": np.repeat(queries["_q"].to_numpy(), ids.shape[1]), "query_id": np.repeat(queries["query_id"].to_numpy(), ids.shape[1]),
            "known_id": ids.reshape(-1), "distance": far.reshape(-1),
        })

    return run


def _first(df: DataFrame, n: int, salt: int) -> DataFrame:
    """``n`` rows by a digest of their id: the same ones each time."""
    return df.orderBy(F.xxhash64(F.lit(salt), "known_id"), "known_id").limit(n)


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: ``known_id, vec, cell, block``, stored by cell; ``sizes``: ``cell, n, blocks``; ``probes``: cells a query looks into."""

    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray
    metric: str
    probes: int
    block_rows: int

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast(self.centres)
        return queries.mapInPandas(_probing(shared, probes), "_q long, query_id long, vec array<double>, cell int")

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, group_rows: int = 2048) -> tuple[DataFrame, int]:
        """The k nearest rows of each query in the cells it probes, ``query_id, rank, known_id, distance``, and how many pairs are compared.

        ``queries`` has ``query_id long, vec``. A query without a vector has no neighbours; rows that repeat an id are answered
        each for itself; an index or a set of queries without rows gives none. ``probes`` of all cells makes the result exact.
        """
        spark = queries.sparkSession
        probes = min(len(self.centres), probes or self.probes)
        if not probes:
            return spark.createDataFrame([], retrieval._HITS), 0
        ship_package()
        asked = queries.select(F.monotonically_increasing_id().alias("_q"), F.col("query_id").cast("long"), _vector(F.col("vec"), self.metric).alias("vec"))
        probed = materialize(self._probed(asked.filter("vec is not null"), probes), "index-probes")
        # One row for each cell, of which there are MOST_CELLS at most.
        loads = materialize(
            probed.groupBy("cell").agg(F.count("*").alias("n_queries")).join(F.broadcast(self.sizes), "cell")
            .withColumn("groups", F.ceil(F.col("n_queries") / group_rows)), "index-loads",
        )
        compared = loads.agg(F.coalesce(F.sum(F.col("n") * F.col("n_queries")), F.lit(0))).first()[0]
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        keys = ["cell", "block", "group"]
        left = (
            probed.join(F.broadcast(loads.select("cell", "blocks", "groups")), "cell")
            .select("_q", "query_id", "vec", "cell", F.pmod(F.xxhash64("_q"), F.col("groups")).alias("group"), each(F.col("blocks")).alias("block"))
        )
        right = (
            self.rows.join(F.broadcast(loads.select("cell", "groups")), "cell")
            .select("known_id", "vec", "cell", "block", each(F.col("groups")).alias("group"))
        )
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_meeting(k), "_q long, query_id long, known_id long, distance double")
        rank = F.row_number().over(Window.partitionBy("_q").orderBy("distance", "known_id"))
        hits = met.withColumn("rank", rank).filter(F.col("rank") <= k)
        shown = F.col("distance") / 2 if self.metric == "cosine" else F.col("distance")
        return hits.select("query_id", "rank", "known_id", shown.alias("distance")), compared


def build(
    known: DataFrame, *, metric: str = "euclidean", k: int = 5, recall: float = 0.95, cells: int | None = None, sample: int = SAMPLE, tests: int = TESTS,
    block_rows: int = 8192,
) -> VectorIndex:
    """An index of every row of ``known`` that has a vector: ``known_id long, vec``, with as many cells as the root of the rows unless ``cells`` says.

    ``recall`` is the share of the ``k`` nearest other rows that the probed cells hold, as measured for ``tests`` rows; more rows that share a distance
    count by their id. Distances are squared Euclidean, or one minus the cosine, where a vector of zeros has the cosine one half to all others. No rows
    give an index without cells.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    ship_package()
    spark = known.sparkSession
    known = materialize(
        known.select(F.col("known_id").cast("long"), _vector(F.col("vec"), metric).alias("vec")).filter("vec is not null"), "index-known"
    )
    n = known.count()
    if not n:
        none = spark.createDataFrame([], "cell int, n long, blocks long")
        return VectorIndex(known.withColumns({"cell": F.lit(0), "block": F.lit(0).cast("long")}), none, np.zeros((0, 0)), metric, 0, block_rows)
    wanted = min(MOST_CELLS, cells or max(1, round(n**0.5)))
    seen = materialize(_first(known, sample, 1).select(array_to_vector("vec").alias("features")), "index-sample")
    if wanted > 1:
        model = KMeans(k=wanted, seed=1, maxIter=12).fit(seen)
        centres = np.stack(model.clusterCenters())
        placed = model.transform(known.withColumn("features", array_to_vector("vec"))).withColumnRenamed("prediction", "cell").drop("features")
    else:
        centres = np.asarray(seen.first()["features"].toArray())[None, :]
        placed = known.withColumn("cell", F.lit(0))
    placed = materialize(placed, "index-placed")
    sizes = materialize(
        placed.groupBy("cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows)), "index-sizes"
    )
    # Numbers of the rows, not digests of their ids, so that repeated rows are spread as well.
    block = F.pmod(F.monotonically_increasing_id(), F.col("blocks"))
    blocked = placed.join(F.broadcast(sizes.select("cell", "blocks")), "cell").select("known_id", "vec", block.alias("block"), "cell")
    path = scratch_dir(spark, "index")
    blocked.repartition("cell", "block").write.partitionBy("cell").parquet(path)
    rows = spark.read.schema("known_id long, vec array<double>, block long, cell int").parquet(path)
    probes = _probes_for(rows, centres, k, recall, tests) if len(centres) > 1 else 1
    return VectorIndex(rows, sizes, centres, metric, probes, block_rows)


def _probes_for(rows: DataFrame, centres: np.ndarray, k: int, recall: float, tests: int) -> int:
    """The fewest cells that hold ``recall`` of the exact neighbours of ``tests`` rows, themselves left out."""
    chosen = materialize(_first(rows, tests, 2).select(F.monotonically_increasing_id().alias("query_id"), "known_id", "vec"), "index-tests")
    exact = retrieval.nearest(chosen.select("query_id", "vec"), rows.select("known_id", "vec"), k + 1)
    itself = chosen.select("query_id", F.col("known_id").alias("own"))
    others = exact.join(itself, "query_id").filter("known_id != own").select("query_id", "known_id")
    # At most tests x (k + 1) ids, which find their cells.
    found = rows.select("known_id", "cell").join(F.broadcast(others), "known_id").select("query_id", "cell").toPandas()
    if found.empty:
        return 1
    asked = chosen.select("query_id", "vec").toPandas()
    order = _order(retrieval._matrix(asked["vec"]), centres)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    line = {q: i for i, q in enumerate(asked["query_id"])}
    ranks = np.sort([place[line[q], c] for q, c in zip(found["query_id"], found["cell"])])
    return int(ranks[min(len(ranks), int(np.ceil(recall * len(ranks)))) - 1]) + 1
