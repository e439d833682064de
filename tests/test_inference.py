import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.operators.inference import FunctionProvider, IdentityProvider, Provider, ask, ask_resumable


def requests(spark, n=200):
    return spark.range(n).select(
        F.col("id").alias("key"), F.concat(F.lit("q"), "id").alias("user"), F.lit("rules").alias("system"),
        F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content"))).alias("history"),
    )


def test_every_request_gets_its_own_reply(spark):
    def describe(user, system, history):
        return f"{user}/{system}/{history[0]['role']}:{history[0]['content']}"

    got = ask(requests(spark), FunctionProvider(describe, requests_per_task=40, threads=4, timeout_sec=30), ["key"])
    assert got.rdd.getNumPartitions() == 5
    rows = {r["key"]: r for r in got.collect()}
    assert len(rows) == 200
    assert all(r["response"] == f"q{k}/rules/user:before" and r["error"] is None for k, r in rows.items())


def test_identity_needs_no_python(spark):
    got = ask(requests(spark, 5), IdentityProvider(), ["key"])
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r["response"] for r in got.orderBy("key").collect()] == [f"q{i}" for i in range(5)]


def test_errors_are_values(spark):
    def sometimes(user, system, history):
        if user.endswith("3"):
            raise ValueError("no threes")
        return "" if user.endswith("4") else user

    asked = requests(spark, 20).withColumn("error", F.when(F.col("key") == 7, "file is empty"))
    rows = {r["key"]: r for r in ask(asked, FunctionProvider(sometimes), ["key"]).collect()}
    assert rows[3]["error"] == rows[13]["error"] == "query failed: no threes"
    assert rows[3]["response"] is None
    assert rows[4]["error"] == "provider returned a malformed reply"
    assert rows[7]["error"] == "file is empty" and rows[7]["response"] is None
    assert sum(r["error"] is None for r in rows.values()) == 15


def test_a_slow_query_times_out_and_the_rest_go_on(spark):
    def slow(user, system, history):
        if user == "q1":
            time.sleep(3)
        return user

    provider = FunctionProvider(slow, requests_per_task=100, threads=4, timeout_sec=0.5)
    rows = {r["key"]: r for r in ask(requests(spark, 6), provider, ["key"]).collect()}
    assert rows[1]["error"] == "query timed out after 0.5 s"
    assert [k for k, r in rows.items() if r["error"] is None] == [k for k in rows if k != 1]


def test_one_thread_is_not_held_up_by_stuck_queries(spark):
    def slow(user, system, history):
        if user in ("q1", "q2"):
            time.sleep(4)
        if user == "q3":
            raise TimeoutError("its own")
        return user

    provider = FunctionProvider(slow, requests_per_task=100, threads=1, timeout_sec=0.4)
    rows = {r["key"]: r for r in ask(requests(spark, 8), provider, ["key"]).collect()}
    assert {k: r["error"] for k, r in rows.items() if r["error"]} == {
        1: "query timed out after 0.4 s", 2: "query timed out after 0.4 s", 3: "query failed: its own",
    }


class Counted(Provider):
    requests_per_task = 13

    def __init__(self, log):
        self.log = log

    def open(self):
        with open(self.log, "a") as f:
            f.write(f"{os.getpid()}\n")

    def reply(self, user, system, history):
        return user


def test_a_model_is_loaded_once_per_process(spark, tmp_path):
    log = str(tmp_path / "opened")
    assert ask(requests(spark), Counted(log), ["key"]).filter("error is null").count() == 200
    opened = open(log).read().split()
    assert len(opened) == len(set(opened)) < 16


class Broken(Provider):
    def open(self):
        raise RuntimeError("no model")


def test_a_provider_that_cannot_start_fails_its_requests(spark):
    rows = ask(requests(spark, 3), Broken(), ["key"]).collect()
    assert {r["error"] for r in rows} == {"provider failed to start: no model"}


def test_a_rerun_asks_only_for_what_is_missing(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), str(tmp_path / "replies")
    os.makedirs(calls)

    def provider(broken):
        def reply(user, system, history):
            open(os.path.join(calls, f"{user}-{time.time_ns()}"), "w").close()
            if user in broken:
                raise ValueError("later")
            return user + "!"

        return FunctionProvider(reply)

    first = {r["key"]: r for r in ask_resumable(requests(spark, 6), provider({"q2"}), ["key"], store).collect()}
    assert first[2]["error"] == "query failed: later" and first[3]["response"] == "q3!"
    assert len(glob.glob(calls + "/*")) == 6
    changed = requests(spark, 7).withColumn("user", F.when(F.col("key") == 4, "new").otherwise(F.col("user")))
    second = {r["key"]: r for r in ask_resumable(changed, provider(set()), ["key"], store).collect()}
    assert [second[k]["response"] for k in range(7)] == ["q0!", "q1!", "q2!", "q3!", "new!", "q5!", "q6!"]
    assert all(r["error"] is None for r in second.values())
    assert len(glob.glob(calls + "/*")) == 6 + 3


def test_finished_slices_survive_a_run_that_dies(spark, tmp_path):
    calls, store = str(tmp_path / "calls"), str(tmp_path / "replies")
    os.makedirs(calls)

    class Counting(Provider):
        def __init__(self, model):
            self.model = model

        def reply(self, user, system, history):
            open(os.path.join(calls, f"{self.model}-{user}-{time.time_ns()}"), "w").close()
            return f"{self.model}:{user}"

    class Dying(Counting):
        def identity(self):
            return Counting("a").identity()

        def reply(self, user, system, history):
            if len(os.listdir(calls)) > 25:
                os._exit(1)  # the task process goes, again and again, until the job does
            return super().reply(user, system, history)

    asked = requests(spark, 40).withColumn("error", F.when(F.col("key") == 5, "no file"))
    with pytest.raises(Exception):
        ask_resumable(asked, Dying("a"), ["key"], store, slice_requests=10).collect()
    kept = spark.read.parquet(store).count()
    assert 10 < kept < 39
    before = len(os.listdir(calls))
    rows = {r["key"]: r for r in ask_resumable(asked, Counting("a"), ["key"], store, slice_requests=10).collect()}
    assert len(os.listdir(calls)) - before == 39 - kept
    assert rows.pop(5)["error"] == "no file" and all(r["response"] == f"a:q{k}" for k, r in rows.items())
    assert spark.read.parquet(store).filter("error = 'no file'").count() == 0
    # Another model's replies are its own.
    again = ask_resumable(asked, Counting("b"), ["key"], store).filter("error is null").collect()
    assert len(again) == 39 and all(r["response"].startswith("b:") for r in again)


class Chat(Provider):
    def reply_to_messages(self, messages):
        return " ".join(f"{m['role']}={m['content']}" for m in messages)


def test_a_chat_model_gets_assembled_messages(spark):
    rows = {r["key"]: r["response"] for r in ask(requests(spark, 3), Chat(), ["key"]).collect()}
    assert rows[1] == "system=rules user=before user=q1"


def test_a_slice_reads_its_own_part(spark, tmp_path, monkeypatch):
    from glyphmill.operators import inference

    read, spread = [], inference._spread

    def watching(asked, count, provider, keys):
        read.append((sorted(asked.inputFiles()), count, asked.count()))
        return spread(asked, count, provider, keys)

    monkeypatch.setattr(inference, "_spread", watching)
    got = ask_resumable(requests(spark, 100), FunctionProvider(lambda user, system, history: user), ["key"], str(tmp_path / "r"), slice_requests=10).collect()
    assert sorted(r["response"] for r in got) == sorted(f"q{i}" for i in range(100))
    assert len(read) > 3 and sum(n for _, n, _ in read) == 100 and all(n == counted for _, n, counted in read)
    files = [f for fs, _, _ in read for f in fs]
    assert len(files) == len(set(files))


def test_slices_are_bounded_in_number(spark, tmp_path, monkeypatch):
    from glyphmill.operators import inference

    spread, sizes = inference._spread, []
    monkeypatch.setattr(inference, "MOST_SLICES", 3)
    monkeypatch.setattr(inference, "_spread", lambda asked, count, *rest: sizes.append(count) or spread(asked, count, *rest))
    got = ask_resumable(requests(spark, 60), FunctionProvider(lambda user, system, history: user), ["key"], str(tmp_path / "r"), slice_requests=5).collect()
    assert sorted(r["response"] for r in got) == sorted(f"q{i}" for i in range(60))
    assert len(sizes) == 3 and sum(sizes) == 60


def test_tasks_are_bounded_in_number_and_slow_requests_wait_together(spark, monkeypatch):
    from glyphmill.operators import inference

    def slow(user, system, history):
        if user.endswith("7"):
            time.sleep(2)
        return user

    monkeypatch.setattr(inference, "TASKS_PER_CORE", 1)
    asked = ask(requests(spark, 160), FunctionProvider(slow, requests_per_task=2, threads=8, timeout_sec=0.5), ["key"])
    assert asked.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = {r["key"]: r for r in asked.collect()}
    assert {k for k, r in rows.items() if r["error"] == "query timed out after 0.5 s"} == {k for k in range(160) if k % 10 == 7}
    assert all(r["response"] == f"q{k}" for k, r in rows.items() if k % 10 != 7)
