"""Nearest known examples by vector similarity, exact at any size.

Distances are squared Euclidean, in double. Neighbours are ranked by the distance
rounded to nine digits and then by id, so that ties come out the same everywhere.

Queries stay where they are. Of known rows with one vector only the first k by id can be among the k nearest,
the others are left out. What remains is measured. Below ``max_local_bytes`` it is sent to every task. Above, it is
written to a shared table, and every task streams that table block by block past a group of its queries, with a
running top k for each. All pairs are compared, in matrix products over tiles; what is held is a group, a block, a
tile and k rows for each query, whatever the tables' sizes. The work is the product of both sides: where the
partitions of the queries would make tasks of more than ``PAIRS_PER_TASK`` pairs, queries are dealt over more tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.embedding import Embedder
from glyphmill.operators.requests import HISTORY, example_messages
from glyphmill.scratch import materialize, ship_package
from glyphmill.worker import kept, key_of

TIE_DIGITS = 9
#: What is collected at the driver and sent to every task at most.
MAX_LOCAL_BYTES = 8 << 20
#: Pairs that a task compares before its queries are dealt over more tasks.
PAIRS_PER_TASK = 8_000_000_000
_VECTOR = "array<double>"
#: Queries and known rows of a tile, and pairs that are measured at a time.
_TILE, _MEASURED = (512, 2048), 16_384
#: Rounding of a distance in single precision, as a share of the norms and for each dimension, with slack.
_SINGLE = 4 * 2.0**-24


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _ranked(
    queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids of its k nearest, in order, and their rounded distances, as two arrays of k columns.

    ``best`` is what this gave for other known rows, which compete. A matrix product finds all that could be among the
    k nearest, with slack for its rounding; those are measured again by plain differences. With fewer than k vectors there
    are fewer columns.
    """
    held = best or (np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0)))
    if not len(queries) or not len(ids):
        return held
    # Around their mean the norms, and with them the slack, are small; single precision where its range allows.
    middle = vectors.mean(axis=0)
    around = vectors - middle
    norms = (around * around).sum(axis=1)
    top = norms.max()
    kind, share = (np.float32, _SINGLE * (vectors.shape[1] + 8)) if 1e-20 < top < 1e20 else (np.float64, 1e-8)
    known = np.hstack([around, norms[:, None]]).astype(kind)
    drift = 1e-12 * (1.0 + (middle * middle).sum() + top)
    out = []
    for start in range(0, len(queries), _TILE[0]):
        block = queries[start : start + _TILE[0]]
        shifted = block - middle
        own = (shifted * shifted).sum(axis=1)
        with np.errstate(all="ignore"):
            asked = np.hstack([-2.0 * shifted, np.ones((len(block), 1))]).astype(kind)
        slack = share * (own + top) + drift
        mine = held[0][start : start + _TILE[0]], held[1][start : start + _TILE[0]]
        for at in range(0, len(ids), _TILE[1]):
            mine = _past(block, asked, own, slack, vectors[at : at + _TILE[1]], known[at : at + _TILE[1]], ids[at : at + _TILE[1]], mine, k)
        out.append(mine)
    return np.concatenate([m[0] for m in out]), np.concatenate([m[1] for m in out])


def _past(block, asked, own, slack, vectors, known, ids, held, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a tile of queries after a tile of known rows."""
    with np.errstate(all="ignore"):
        rough = asked @ known.T  # distances, less the norms of the queries
    if held[1].shape[1] == k:
        bound = held[1][:, -1] + 10.0**-TIE_DIGITS - own + slack
    elif len(ids) > k:
        bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + 10.0**-TIE_DIGITS + 2 * slack
    else:
        bound = np.full(len(block), np.inf)
    # Rounded up, and what can't be compared is measured, too.
    bound = np.nextafter(bound.astype(rough.dtype), np.array(np.inf, rough.dtype))
    rows, columns = np.divmod(np.flatnonzero(~(rough > bound[:, None])), len(ids))
    if not len(rows):
        return held
    far = np.empty(len(rows))
    for at in range(0, len(rows), _MEASURED):
        gaps = vectors[columns[at : at + _MEASURED]] - block[rows[at : at + _MEASURED]]
        far[at : at + _MEASURED] = np.round((gaps * gaps).sum(axis=1), TIE_DIGITS)
    return _first(held, rows, ids[columns], far, k)


def _first(held: tuple[np.ndarray, np.ndarray], rows: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by distance, then id, of what is held for each row and of the new ``ids`` of ``rows``."""
    touched, width = np.unique(rows), held[0].shape[1]
    line = np.concatenate([np.repeat(touched, width), rows])
    ids, far = np.concatenate([held[0][touched].reshape(-1), ids]), np.concatenate([held[1][touched].reshape(-1), far])
    order = np.lexsort((ids, far, line))
    line = line[order]
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    first = order[np.arange(len(line)) - np.repeat(starts, np.diff(np.r_[starts, len(line)])) < k]
    if width == k:
        held = held[0].copy(), held[1].copy()
        held[0][touched], held[1][touched] = ids[first].reshape(-1, k), far[first].reshape(-1, k)
        return held
    return ids[first].reshape(len(touched), -1), far[first].reshape(len(touched), -1)  # all rows, which gain equally


def _size(known: DataFrame) -> tuple[int, int]:
    row = known.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("values")
    ).first()
    return row["n"], row["values"] * 8 + row["n"] * 8


def _first_copies(known: DataFrame, k: int) -> DataFrame:
    """Of rows with the same vector the first k by id: no other can be among the k nearest of a query."""
    copy = F.row_number().over(Window.partitionBy("vec").orderBy("known_id"))
    return known.withColumn("_copy", copy).filter(F.col("_copy") <= k).drop("_copy")


def nearest(
    queries: DataFrame,
    known: DataFrame,
    k: int,
    *,
    max_local_bytes: int = MAX_LOCAL_BYTES,
    group_bytes: int = 16 << 20,
    block_rows: int = 8192,
) -> DataFrame:
    """The k nearest known rows of each query: ``query_id, rank, known_id, distance``.

    ``queries`` has ``query_id long, vec``; ``known`` has ``known_id long, vec``. The known table is read once
    for every ``group_bytes`` of queries in a task.
    """
    ship_package()
    queries = queries.select(F.col("query_id").cast("long"), F.col("vec").cast(_VECTOR))
    known = known.select(F.col("known_id").cast("long"), F.col("vec").cast(_VECTOR))
    known = materialize(_first_copies(known, k), "knn-known")
    n, size = _size(known)
    if n == 0:
        return queries.sparkSession.createDataFrame([], _HITS)
    tasks = -(-queries.count() * n // PAIRS_PER_TASK)
    if tasks > queries.rdd.getNumPartitions():
        queries = queries.repartition(tasks)
    if size <= max_local_bytes:
        return _nearest_local(queries, known, k)
    return _nearest_in_blocks(queries, known, k, group_bytes, block_rows)


_HITS = "query_id long, rank int, known_id long, distance double"


def _hits(qids: np.ndarray, ids: np.ndarray, far: np.ndarray) -> pd.DataFrame:
    n, k = ids.shape
    return pd.DataFrame({
        "query_id": np.repeat(qids, k), "rank": np.tile(np.arange(1, k + 1, dtype="int32"), n), "known_id": ids.reshape(-1), "distance": far.reshape(-1),
    })


def _nearest_local(queries: DataFrame, known: DataFrame, k: int) -> DataFrame:
    local = known.orderBy("known_id").toPandas()  # within the bound the caller has checked
    shared = queries.sparkSession.sparkContext.broadcast((local["known_id"].to_numpy(), _matrix(local["vec"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        for pdf in batches:
            if len(pdf):
                yield _hits(pdf["query_id"].to_numpy(), *_ranked(_matrix(pdf["vec"]), vectors, ids, k))

    return queries.mapInPandas(run, _HITS)


def _nearest_in_blocks(queries: DataFrame, known: DataFrame, k: int, group_bytes: int, block_rows: int) -> DataFrame:
    files = sorted(known.inputFiles())  # one name per task that wrote the table

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        import pyarrow.parquet as pq

        from glyphmill.sources.tree import _filesystem

        for name in files:
            system, inner = _filesystem(name)
            with system.open_input_file(inner) as f:
                for batch in pq.ParquetFile(f, pre_buffer=False).iter_batches(batch_size=block_rows, use_threads=False):
                    if batch.num_rows:
                        yield batch.column("known_id").to_numpy(), _matrix(batch.column("vec").to_numpy(zero_copy_only=False))

    def answered(group: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        qids, vectors = np.concatenate([q for q, _ in group]), np.concatenate([v for _, v in group])
        best = None
        for ids, block in blocks():
            best = _ranked(vectors, block, ids, k, best)
        return _hits(qids, *best)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = [], 0
        for pdf in batches:
            if len(pdf):
                group.append((pdf["query_id"].to_numpy(), _matrix(pdf["vec"])))
                held += group[-1][1].nbytes
            if held >= group_bytes:
                yield answered(group)
                group, held = [], 0
        if group:
            yield answered(group)

    return queries.mapInPandas(run, _HITS)


def embed(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "vec") -> DataFrame:
    ship_package()
    return df.withColumn(out, embedder.as_column(F.col(text)))


def attach_history(
    pieces: DataFrame,
    known: DataFrame | None,
    embedder: Embedder,
    k: int,
    user_request: str,
    assistant_response: str,
    *,
    code: str = "code",
    max_local_bytes: int = MAX_LOCAL_BYTES,
) -> DataFrame:
    """Add ``history``: the nearest known pairs of each piece as messages, nearest first.

    The code itself is looked up, not the prompt around it. ``known`` has ``id``,
    ``source`` and ``target``; without it every history is empty.
    """
    if known is None:
        return pieces.withColumn("history", F.array().cast(HISTORY))
    ship_package()
    # Embedded once: what is sent is measured, texts and vectors.
    vectors = materialize(embed(known, embedder, "source"), "known-vectors")
    sized = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length("source") + F.octet_length("target") + 8 * F.size("vec")), F.lit(0)).alias("bytes"),
    ).first()
    if sized["n"] == 0:
        return pieces.withColumn("history", F.array().cast(HISTORY))
    if sized["bytes"] + 64 * sized["n"] <= max_local_bytes:
        examples = _examples_local(pieces.sparkSession, vectors, embedder, k)(F.col(code))
        return pieces.withColumn(
            "history", F.coalesce(example_messages(examples, user_request, assistant_response), F.array().cast(HISTORY))
        )
    return _attach_by_join(pieces, vectors, embedder, k, user_request, assistant_response, code, max_local_bytes)


def _examples_local(spark, vectors: DataFrame, embedder: Embedder, k: int):
    local = vectors.select(F.col("id").cast("long"), "source", "target", "vec").orderBy("id").toPandas()
    shared = spark.sparkContext.broadcast(
        (local["id"].to_numpy(), _matrix(local["vec"]), local["source"].tolist(), local["target"].tolist())
    )

    key = key_of(embedder)

    @F.pandas_udf("array<struct<source:string,target:string>>")
    def examples(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, matrix, sources, targets = shared.value
        place = {known_id: i for i, known_id in enumerate(ids)}
        encode = kept(key, embedder.load)
        for texts in batches:
            out = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if isinstance(t, str)]
            if asked:
                queries = _matrix(list(encode([texts.iloc[i] for i in asked])))
                for i, near in zip(asked, _ranked(queries, matrix, ids, k)[0]):
                    out[i] = [{"source": sources[r], "target": targets[r]} for r in map(place.__getitem__, near)]
            yield pd.Series(out, index=texts.index)

    return examples


def salted(hits: DataFrame, texts: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``, so that no ``known_id`` and ``salt`` has many more than 1 in ``parts`` of all ``hits``.

    An example near everything has as many copies of its text as its hits need; there are ``parts`` such examples
    at most, which are sent to the tasks by id. All others have one text. ``hits`` is read twice.
    """
    spark = hits.sparkSession
    parts = parts or 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = max(1, -(-hits.count() // parts))
    counts = hits.groupBy("known_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share)
    hot = F.broadcast(materialize(counts.select("known_id", F.ceil(F.col("_n") / share).alias("_copies")), "hot-examples"))
    copies = F.coalesce("_copies", F.lit(1).cast("long"))
    spread = hits.join(hot, "known_id", "left").withColumn("salt", F.pmod(F.xxhash64("query_id"), copies)).drop("_copies")
    repeated = texts.join(hot, "known_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_copies")
    return spread, repeated


def _attach_by_join(pieces, vectors, embedder, k, user_request, assistant_response, code, max_local_bytes):
    """The way for a known side too large to send: nearest in blocks, then equi-joins."""
    vectors = vectors.withColumn("id", F.col("id").cast("long"))
    # Written before it is used twice, which also makes the numbers stay with their rows.
    numbered = materialize(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    queries = embed(
        numbered.filter(F.col(code).isNotNull()).select(F.col("_piece").alias("query_id"), F.col(code).alias("text")),
        embedder,
    ).select("query_id", "vec")
    hits = nearest(queries, vectors.select(F.col("id").alias("known_id"), "vec"), k, max_local_bytes=max_local_bytes)
    hits, texts = salted(materialize(hits, "hits"), vectors.select(F.col("id").alias("known_id"), "source", "target"))
    histories = (
        hits.join(texts.hint("merge"), ["known_id", "salt"])
        .groupBy(F.col("query_id").alias("_piece"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "source", "target"))).alias("_examples"))  # k rows
    )
    joined = numbered.join(histories, "_piece", "left")
    return joined.withColumn(
        "history",
        F.coalesce(example_messages(F.col("_examples"), user_request, assistant_response), F.array().cast(HISTORY)),
    ).drop("_piece", "_examples")
