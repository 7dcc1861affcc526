"""The job lifecycle, in batch and as streams, and the metrics."""

import itertools
import json
from random import Random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from bindery.functions import frames
from bindery.operators import jobs, metrics
from bindery.plans import commit
from bindery.streaming import jobs as streams


def events(spark, *lists):
    rows = [(f"j{k}", i, e, "boom") for k, names in enumerate(lists) for i, e in enumerate(names)]
    return spark.createDataFrame(rows, "job_id string, seq long, event string, error_message string").withColumn("ts", F.timestamp_seconds("seq"))


def test_fold_agrees_with_single_steps(spark):
    lists = list(itertools.product(jobs.TRANSITIONS, repeat=3)) + [("claim", "cancel", "complete", "fail"), ("fail", "complete"), ("unknown",)]
    got = {r.job_id: (r.status, r.error_message, r.applied) for r in jobs.fold_states(events(spark, *lists)).collect()}
    for k, names in enumerate(lists):
        state = ("pending", "", 0)
        for e in names:
            state = streams.stepped(state, e, "boom")
        assert got[f"j{k}"] == state
        if "cancel" in names and got[f"j{k}"][0] != "canceled" and names.index("cancel") == 0:
            assert "publish_error" in names


def test_states(spark):
    got = {r.job_id: r.status for r in jobs.fold_states(events(spark, ["claim", "complete"], ["claim", "cancel", "complete"], ["claim", "claim"], ["cancel", "publish_error"], ["claim", "fail"])).collect()}
    assert got == {"j0": "completed", "j1": "canceled", "j2": "processing", "j3": "failed", "j4": "failed"}


def some_jobs(spark):
    rows = [("1", "u", "md", "failed", None, 1, 0, 10), ("2", "u", "md", "pending", "1", 2, 5, 5), ("3", "v", "pdf", "completed", None, 1, 0, 30), ("4", "v", "pdf", "canceled", None, 3, 7, 9), ("5", "u", "md", "pending", "1", 3, 5, 5)]
    out = spark.createDataFrame(rows, "id string, user_id string, format string, status string, retry_of string, attempt int, a int, b int")
    return out.withColumns({"created_at": F.timestamp_seconds("a"), "updated_at": F.timestamp_seconds("b"), "object_key": F.lit("k"), "error_message": F.lit(None).cast("string")})


def test_bundle_and_user_lookups(spark):
    bundles = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "job_id string, path string")
    users = spark.createDataFrame([("1", "a@b.c"), ("2", "A@b.c"), ("3", None)], "id string, email string")
    assert [r.path for r in jobs.bundle(bundles, "2").collect()] == ["b"] and jobs.bundle(bundles, "3").count() == 0
    assert [r.email for r in jobs.user(users, "2").collect()] == ["A@b.c"]
    assert [r.id for r in jobs.user_by_email(users, "a@b.c").collect()] == ["1"]


def test_lookups(spark):
    found = some_jobs(spark)
    assert [(r.retry_of, r.id) for r in jobs.latest_retry(found).collect()] == [("1", "5")]
    assert [r.id for r in jobs.user_jobs(found, "u").orderBy("place").collect()] == ["2", "5", "1"]
    assert [(r.id, r.attempt, r.retry_of) for r in jobs.new_retries(found, F.current_timestamp()).collect()] == [("4-r", 4, "4")]
    assert jobs.job(found, "1").collect()[0].error_message == "" and jobs.canceled(found).count() == 1


def test_metrics(spark):
    found = some_jobs(spark)
    bundles = spark.createDataFrame([("3", "valid"), ("9", "valid")], "job_id string, validation string")
    assert {r.status: r.n for r in metrics.jobs_by(found, "status").collect()} == {"failed": 1, "pending": 2, "completed": 1, "canceled": 1}
    assert {r.status: r.n for r in metrics.jobs_by(found, "status", "v").collect()} == {"completed": 1, "canceled": 1}
    assert metrics.average_duration(found).collect()[0].avg_seconds == 20.0
    assert metrics.average_duration(found.limit(0)).collect()[0].avg_seconds == 0.0
    assert [tuple(r) for r in metrics.bundles_by_validation(found, bundles).collect()] == [("valid", 1)]
    text = metrics.prometheus_text(found, bundles).collect()[0].text
    assert text.startswith('# HELP bindery_jobs_total Trabajos de conversión por estado.\n# TYPE bindery_jobs_total gauge\nbindery_jobs_total{status="canceled"} 1\n')
    assert text.endswith("# TYPE bindery_retries_total counter\nbindery_retries_total 2\n") and "bindery_job_duration_seconds 20.000\n" in text


def test_message_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    message = lambda k: json.dumps({"job_id": k, "user_id": "u", "format": "md", "object_key": "o", "attempt": 1})
    (source / "a.json").write_text("\n".join([message("1"), message("2"), "{broken", message("1")]))

    def run():
        found = streams.message_stream(spark, str(source))
        streams.run_claims(found, lambda df: df, str(tmp_path / "claims"), str(tmp_path / "dead"), str(tmp_path / "check")).awaitTermination()
        return sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "claims")).collect()), [r.value for r in spark.read.parquet(str(tmp_path / "dead")).collect()]

    assert run() == (["1", "2"], ["{broken"])
    (source / "b.json").write_text("\n".join([message("2"), message("3"), "[]"]))
    claims, dead = run()
    assert claims == ["1", "2", "3"] and "{broken" in dead


def test_failed_conversions_are_dead_letters(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    message = lambda k: json.dumps({"job_id": k, "user_id": "u", "format": "md", "object_key": "o", "attempt": 1})
    (source / "a.json").write_text("\n".join([message("1"), message("2"), "{broken", "{broken"]))
    failing = lambda df: df.withColumn("error", F.when(F.col("job_id") == "2", "it fails"))
    streams.run_claims(streams.message_stream(spark, str(source)), failing, str(tmp_path / "claims"), str(tmp_path / "dead"), str(tmp_path / "check")).awaitTermination()
    assert [r.job_id for r in spark.read.parquet(str(tmp_path / "claims")).collect()] == ["1"]
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == sorted([message("2"), "{broken", "{broken"])


def test_state_stream(spark, tmp_path):
    found = events(spark, ["claim", "complete"], ["claim", "cancel", "complete"], ["claim", "fail"])
    found.write.parquet(str(tmp_path / "in"))
    stream = streams.job_states(spark.readStream.schema(found.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.job_id: (r.status, r.error_message, r.applied) for r in spark.sql("SELECT * FROM states").collect()}
    assert got == {r.job_id: (r.status, r.error_message, r.applied) for r in jobs.fold_states(found).collect()}


def test_decode(spark):
    rows = jobs.decoded(spark.createDataFrame([('{"job_id": "1"}',), ("nope",), ("{}",), (None,)], "value string")).collect()
    assert [r.dead for r in rows] == [False, True, True, True]


def state_run(spark, tmp_path, keep=3600, delay="100 seconds"):
    """Reads the files that are there, one in each micro-batch: the last row of each job so far, and the jobs in state."""
    rows = []
    stream = spark.readStream.schema("job_id string, seq long, event string, error_message string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streams.job_states(stream, delay, keep).writeStream.outputMode("update").foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.job_id: (r.status, r.error_message, r.applied) for r in rows}, q.lastProgress["stateOperators"][0]


def put_events(spark, tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    lines = [json.dumps({"job_id": j, "seq": s, "event": e, "error_message": "boom", "ts": f"2024-01-01T{at // 3600:02d}:{at // 60 % 60:02d}:{at % 60:02d}Z"}) for j, s, e, at in rows]
    (tmp_path / "in" / name).write_text("\n".join(lines))


def test_late_events_end_as_the_batch_fold(spark, tmp_path):
    """A job's events come in the wrong order, over several micro-batches: each update equals the fold of what is there."""
    put_events(spark, tmp_path, "1.json", [("a", 3, "complete", 30), ("b", 1, "claim", 10), ("c", 2, "cancel", 95)])
    put_events(spark, tmp_path, "2.json", [("a", 1, "claim", 10), ("b", 3, "fail", 50), ("c", 3, "complete", 96)])
    put_events(spark, tmp_path, "3.json", [("a", 2, "cancel", 20), ("b", 2, "complete", 40), ("c", 1, "claim", 94), ("d", 1, "claim", 90)])
    found, _ = state_run(spark, tmp_path)
    batch = spark.read.schema("job_id string, seq long, event string, error_message string, ts timestamp").json(str(tmp_path / "in"))
    assert found == {r.job_id: (r.status, r.error_message, r.applied) for r in jobs.fold_states(batch).collect()}
    assert found == {"a": ("canceled", "", 2), "b": ("failed", "boom", 3), "c": ("canceled", "", 2), "d": ("processing", "", 1)}


def test_state_of_ended_jobs_is_forgotten(spark, tmp_path):
    """State rows shrink once jobs have been terminal for long; those at work stay; too late an event changes nothing."""
    put_events(spark, tmp_path, "1.json", [(f"j{k}", 1, "claim", k) for k in range(40)])
    put_events(spark, tmp_path, "2.json", [(f"j{k}", 2, "complete", 50 + k) for k in range(30)])
    _, before = state_run(spark, tmp_path, keep=200)
    put_events(spark, tmp_path, "3.json", [("late", 1, "claim", 5000)])
    put_events(spark, tmp_path, "4.json", [("j35", 2, "complete", 60), ("late", 2, "complete", 5001)])
    found, after = state_run(spark, tmp_path, keep=200)
    assert "j35" not in found or found["j35"] == ("processing", "", 1)
    assert found["late"] == ("completed", "", 2) and after["numRowsTotal"] < before["numRowsTotal"]
    put_events(spark, tmp_path, "5.json", [("j36", 2, "fail", 5100), ("j0", 3, "claim", 5100)])
    found, _ = state_run(spark, tmp_path, keep=200)
    assert found["j36"] == ("failed", "boom", 2) and found["j0"] == ("processing", "", 1)  # j0 begins anew


def test_tables_of_a_batch_are_removed(spark, tmp_path):
    """What a conversion settles is gone once its batch is written, also where the batch fails."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"job_id": "1", "user_id": "u", "format": "md", "object_key": "o", "attempt": 1}))
    seen = []

    def converted(df):
        out = frames.settled(df)
        seen.append(frames.SETTLED[-1])
        return out

    streams.run_claims(streams.message_stream(spark, str(source)), converted, str(tmp_path / "claims"), str(tmp_path / "dead"), str(tmp_path / "check")).awaitTermination()
    assert [r.job_id for r in spark.read.parquet(str(tmp_path / "claims")).collect()] == ["1"]
    gone = lambda path: not commit.exists(spark, path)
    assert seen and all(map(gone, seen)) and not set(seen) & set(frames.SETTLED)
    with pytest.raises(ValueError), frames.scratch(spark):
        frames.settled(spark.range(3))
        path = frames.SETTLED[-1]
        raise ValueError
    assert gone(path)


def test_new_jobs_cost_few_calls_on_the_state():
    """A job without a state asks neither for open events nor for timers; a known one does."""
    calls = []

    class State:
        def __init__(self, name, held):
            self.name, self.held = name, held

        def __getattr__(self, call):
            return lambda *x: calls.append((self.name, call)) or self.held

    class Timers:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    row = Row(micros=5, seq=1, event="claim", error_message=None)
    for before, most in ((None, 3), (("pending", "", 0, 0), 5)):
        p = streams.JobProcessor(1000)
        p.handle, p.settled, p.open = State("handle", []), State("settled", before), State("open", [])
        calls.clear()
        assert list(p.handleInputRows(("a",), iter([row]), Timers())) == [Row(job_id="a", status="processing", error_message="", applied=1)]
        assert len(calls) <= most and (("open", "get") in calls) == (before is not None) == (("handle", "listTimers") in calls)


def test_state_is_held_by_blocks(spark, tmp_path):
    """Many jobs make few rows of state and few calls on it, not some for each job."""
    put_events(spark, tmp_path, "1.json", [(f"j{k}", 1, ("claim", "complete")[k % 2], k % 60) for k in range(3000)])
    found, state = state_run(spark, tmp_path)
    assert len(found) == 3000 and found["j1"] == ("completed", "", 1) and state["numRowsTotal"] < 1500


def test_blocks_end_as_jobs_alone(spark, tmp_path):
    """Each micro-batch's rows: of blocks as of jobs alone, with late events, jobs that are forgotten and begin anew, and odd values."""
    random = Random(4)
    names, jobs_ = [*jobs.TRANSITIONS, "unknown", None], [*(f"j{k}" for k in range(25)), 'é"\n', "", None]
    for k in range(6):
        rows = [(random.choice(jobs_), random.randrange(10**17, 10**18), random.choice(names), max(0, 150 * k + random.randrange(-250, 150))) for _ in range(60)]
        put_events(spark, tmp_path, f"{k}.json", rows)
    schema = "job_id string, seq long, event string, error_message string, ts timestamp"
    end = spark.createDataFrame([("far", 1, "claim", None)], "job_id string, seq long, event string, error_message string").withColumn("ts", F.lit("9000-01-01").cast("timestamp"))

    def run(**blocks):
        out, at = [], tmp_path / f"check-{len(list(tmp_path.iterdir()))}"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        states = streams.job_states(stream, "100 seconds", 120, **blocks)
        states.writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(at)).trigger(availableNow=True).start().awaitTermination()
        return sorted(out, key=repr)

    end.write.mode("append").json(str(tmp_path / "in"))
    alone = run(blocks=None)
    assert alone == run(blocks=2) == run() and {r[1] for r in alone} == {*jobs_, "far"}
    assert any(a[1] == b[1] and a[0] < b[0] and a[4] > b[4] for a in alone for b in alone)  # some job began anew


class Held:
    """A block's state and handle, and the calls on them."""

    def __init__(self, value=None):
        self.value, self.calls, self.timers = value, [], []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("registerTimer")
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("deleteTimer")
        self.timers.remove(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def block(held, blocks=4):
    out = streams.BlockProcessor(1000, blocks)
    out.handle = out.block = held
    return out


def messages(*rows):
    return iter([pd.DataFrame({"message": [json.dumps(dict(zip(("job_id", "micros", "seq", "event"), r, strict=True)))]}) for r in rows])


def test_blocks_cost_few_calls_on_the_state():
    held = Held()
    rows = [(f"j{k}", 10**6 + k, 1, "complete") for k in range(500)]
    (got,) = block(held).handleInputRows((3,), messages(*rows), Watermark(0))
    assert len(got) == 500 and set(got.status) == {"completed"} and len(held.calls) == 3
    (got,) = block(held).handleInputRows((3,), messages(("j0", 9 * 10**6, 2, "fail")), Watermark(0))
    assert got.values.tolist() == [["j0", "failed", "", 2]] and len(held.calls) <= 7
    with pytest.raises(ValueError, match="4 blocks"):
        list(block(held, 5).handleInputRows((3,), messages(*rows), Watermark(0)))


def test_block_timer_is_of_the_job_forgotten_next():
    held = Held()
    list(block(held).handleInputRows((3,), messages(("a", 5 * 10**6, 1, "complete"), ("b", 3 * 10**6, 2, "fail"), ("c", 10**6, 3, "claim")), Watermark(0)))
    assert held.timers == [4000]
    held.timers.remove(4000)  # as Spark does
    list(block(held).handleExpiredTimer((3,), Watermark(4000), None))
    assert held.timers == [6000] and sorted(j[0] for j in json.loads(held.value[0])) == ["a", "c"]
    list(block(held).handleInputRows((3,), messages(("c", 7 * 10**6, 4, "cancel")), Watermark(4000)))
    assert held.timers == [6000]
    held.timers.remove(6000)
    list(block(held).handleExpiredTimer((3,), Watermark(9000), None))
    assert held.value is None and not held.timers
