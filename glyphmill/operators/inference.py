"""Asking a provider: one reply or one error per request."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.requests import HISTORY, assemble_messages
from glyphmill.scratch import materialize, scratch_dir, ship_package
from glyphmill.worker import kept, key_of

MALFORMED = "provider returned a malformed reply"
#: Tasks for each core, and slices of a resumable run, at most: beyond, tasks and slices grow with the requests.
TASKS_PER_CORE, MOST_SLICES = 32, 32
#: Requests that are in hand at a time in a task.
_IN_HAND = 2048


class Provider:
    """What answers requests. Subclass and implement ``reply``; ``open`` loads the model, once per process.

    ``requests_per_task`` sets how many requests make a task (more, where there would be over ``TASKS_PER_CORE`` tasks
    for each core, so that slow requests of a task wait together), ``threads`` how many are in flight in a task, ``timeout_sec`` how long one may take. None of them changes a reply.
    """

    requests_per_task: int = 256
    threads: int = 1
    timeout_sec: float | None = None

    def identity(self) -> str:
        """Names whatever a reply depends on besides the request: the class and its settings."""
        knobs = ("requests_per_task", "threads", "timeout_sec")
        settings = sorted((k, repr(v)) for k, v in vars(self).items() if k not in knobs)
        return f"{type(self).__module__}.{type(self).__qualname__} {settings}"

    def open(self) -> None:
        pass

    def reply(self, user: str, system: str | None, history: list[dict]) -> str:
        raise NotImplementedError

    def reply_to_messages(self, messages: list[dict]) -> str:
        """For chat models: override this instead, and the conversation arrives assembled in the plan."""
        raise NotImplementedError

    def as_column(self, user: Column) -> Column | None:
        """A native expression for the reply, if there is one: then no Python runs."""
        return None


class IdentityProvider(Provider):
    """The reply is the question."""

    def reply(self, user, system, history):
        return user

    def as_column(self, user):
        return user


class FunctionProvider(Provider):
    """A plain function ``(user, system, history) -> str``."""

    def __init__(self, fn: Callable, *, requests_per_task=256, threads=1, timeout_sec=None):
        self.fn, self.requests_per_task, self.threads, self.timeout_sec = fn, requests_per_task, threads, timeout_sec

    def identity(self):
        return f"{self.fn.__module__}.{self.fn.__qualname__}"

    def reply(self, user, system, history):
        return self.fn(user, system, history)


def check_reply(df: DataFrame, response: str = "response") -> DataFrame:
    """A missing or empty reply becomes an error."""
    bad = F.when(F.coalesce(F.col(response), F.lit("")) == "", MALFORMED)
    earlier = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return df.withColumn("error", F.coalesce(earlier, bad))


def _complete(requests: DataFrame) -> DataFrame:
    """What a request may leave out, as nulls."""
    for name, kind in (("error", "string"), ("system", "string"), ("history", HISTORY)):
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    return requests


def ask(requests: DataFrame, provider: Provider, keys: list[str]) -> DataFrame:
    """``keys`` plus ``response`` and ``error`` for each request row.

    Rows that already carry an error pass through unasked. Requests are written, counted and spread by
    a hash of their keys into tasks of about ``requests_per_task``, so the pieces of one large file land in many
    tasks, and a recomputed task gets the same rows again. Only keys and replies come back from Python.
    """
    requests = _complete(requests)
    native = provider.as_column(F.col("user"))
    if native is not None:
        replied = requests.withColumn("response", F.when(F.col("error").isNull(), native))
        return check_reply(replied.select(*keys, "response", "error"))

    asked = materialize(requests.select(*keys, "user", "system", "history", "error"), "asked")
    return _spread(asked, asked.count(), provider, keys)


def _spread(asked: DataFrame, count: int, provider: Provider, keys: list[str]) -> DataFrame:
    """``ask`` for written requests of a known number."""
    ship_package()
    most = TASKS_PER_CORE * asked.sparkSession.sparkContext.defaultParallelism
    n = min(most, max(1, -(-count // max(1, provider.requests_per_task))))
    schema = T.StructType(
        [asked.schema[k] for k in keys]
        + [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    )

    if type(provider).reply_to_messages is not Provider.reply_to_messages:
        messages = assemble_messages(F.col("user"), F.col("system"), F.col("history"))
        asked = asked.select(*keys, messages.alias("messages"), "error")
    key = key_of(provider)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _answer(provider, key, batches, keys)

    return check_reply(asked.repartition(n, *keys).mapInPandas(run, schema))


def _answer(provider: Provider, key: str, batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    from concurrent.futures import ThreadPoolExecutor

    def new_pool():
        return ThreadPoolExecutor(max_workers=max(1, provider.threads))

    def opened():
        provider.open()
        return provider

    try:
        provider, broken = kept(key, opened), None
    except Exception as e:
        broken = f"provider failed to start: {e}"
    pool = new_pool()
    try:
        for pdf in (b[at : at + _IN_HAND] for b in batches for at in range(0, len(b), _IN_HAND)):
            rows, begun = list(pdf.itertuples(index=False)), {}

            def call(i):
                begun[i] = time.monotonic()
                if hasattr(rows[i], "messages"):
                    return provider.reply_to_messages(_plain(rows[i].messages))
                return provider.reply(rows[i].user, rows[i].system, _plain(rows[i].history))

            earlier = [r.error if isinstance(r.error, str) else broken for r in rows]
            flights = {i: pool.submit(call, i) for i, e in enumerate(earlier) if e is None}
            done = []
            for i in range(len(rows)):
                if i not in flights:
                    done.append((None, earlier[i]))
                elif _settled(flights[i], i, begun, provider.timeout_sec):
                    failure = flights[i].exception()
                    done.append((None, f"query failed: {failure}") if failure else (flights[i].result(), None))
                else:
                    done.append((None, f"query timed out after {provider.timeout_sec} s"))
                    # Its thread may never come back: those still waiting move to new threads.
                    pool.shutdown(wait=False, cancel_futures=True)
                    pool = new_pool()
                    flights.update({j: pool.submit(call, j) for j, f in flights.items() if f.cancelled()})
            out = pdf[keys].copy()
            out["response"] = [reply for reply, _ in done]
            out["error"] = [error for _, error in done]
            yield out
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def _settled(flight, i: int, begun: dict[int, float], timeout: float | None) -> bool:
    """Wait for a query until it is done, or until its time, counted from its start, is over."""
    from concurrent.futures import wait

    while not flight.done():
        left = None
        if timeout is not None:
            left = begun[i] + timeout - time.monotonic() if i in begun else 0.05
            if left <= 0:
                return False
        wait([flight], timeout=left)
    return True


def _plain(history) -> list[dict]:
    if history is None:
        return []
    return [m if isinstance(m, dict) else m.asDict() for m in history]


def ask_resumable(requests: DataFrame, provider: Provider, keys: list[str], store: str, *, slice_requests: int | None = None) -> DataFrame:
    """Like ``ask``, with replies kept in a table at ``store``: a rerun asks only for what is missing.

    A stored reply counts if the keys, the provider and a hash of the whole request agree. Missing replies are asked for
    and committed in slices of about ``slice_requests`` (by default what keeps all cores busy for some tasks each), ``MOST_SLICES`` of them
    at most since each is a job of its own, so a run that dies keeps all slices before. Open requests are laid out in a folder for each slice, and a slice reads its own. Errors of a
    provider are stored and asked for again; rows that came with an error are neither asked nor stored.
    """
    spark = requests.sparkSession
    slice_requests = slice_requests or max(20_000, 4 * spark.sparkContext.defaultParallelism * max(1, provider.requests_per_task))
    digest = F.sha2(F.concat(F.lit(provider.identity()), F.to_json(F.struct("system", "history", "user"))), 256)
    tagged = materialize(_complete(requests).withColumn("request_hash", digest), "requests")
    cols = [*keys, "request_hash"]
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in tagged.select(*cols).schema]
        + [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    )
    spark.createDataFrame([], schema).write.mode("append").parquet(store)
    good = spark.read.schema(schema).parquet(store).filter(F.col("error").isNull())
    missing = tagged.filter(F.col("error").isNull()).join(good.select(*cols), cols, "left_anti")
    asked = tagged.filter(F.col("error").isNull()).count()
    slices = min(MOST_SLICES, max(1, -(-asked // slice_requests)))
    place = F.pmod(F.xxhash64(*cols), F.lit(slices)).cast("int")
    missing = missing.select(*cols, "user", "system", "history", "error")
    path, layout = scratch_dir(spark, "missing"), missing.schema
    missing.withColumn("_slice", place).repartition("_slice").write.partitionBy("_slice").parquet(path)
    laid = spark.read.schema(T.StructType([*layout, T.StructField("_slice", T.IntegerType())])).parquet(path)
    # One row for each slice that has open requests.
    for row in laid.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).orderBy("_slice").collect():
        part = spark.read.schema(layout).parquet(f"{path}/_slice={row['_slice']}")
        _spread(part, row["n"], provider, cols).write.mode("append").parquet(store)
    # One row per request, a good reply before an error; the maximum combines before the shuffle.
    best = (
        spark.read.schema(schema).parquet(store)
        .groupBy(*cols)
        .agg(F.max(F.struct(F.col("error").isNull().alias("ok"), "response", "error")).alias("r"))
        .select(*cols, F.col("r.response").alias("response"), F.col("r.error").alias("_error"))
    )
    joined = tagged.select(*cols, "error").join(best, cols, "left")
    response = F.when(F.col("error").isNull(), F.col("response"))
    return joined.select(*keys, response.alias("response"), F.coalesce("error", "_error").alias("error"))
