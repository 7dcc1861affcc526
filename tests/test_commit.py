"""What can be seen of runs that break off, of jobs that are canceled late, and of messages that are sent twice."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bindery.plans import commit
from bindery.streaming import jobs as streams
from bindery.streaming import queue


@pytest.fixture
def bundle(spark):
    rows = [(f"j{k}", f"conceptos/{n}.md", f"text {k} {n}".encode()) for k in range(6) for n in range(k % 3 + 1)] + [(f"j{k}", "index.md", b"# i") for k in range(6)]
    files = spark.createDataFrame(rows, "job_id string, path string, content binary")
    return files, files.select("job_id", F.lit("u").alias("user_id")).distinct()


def seen(spark, path):
    return sorted((r.job_id, r.path, bytes(r.content)) for r in commit.visible(spark, path).collect())


def test_a_run_that_breaks_off_shows_nothing(spark, tmp_path, bundle, monkeypatch):
    files, jobs = bundle
    path, move = str(tmp_path / "b"), commit.moved
    assert seen(spark, path) == [] and commit.manifests(spark, path).collect() == []
    for stop in (0, 1):  # before the data are moved in place, and before the manifest is
        calls = []

        def broken(spark, source, target, stop=stop, calls=calls):
            calls.append(target)
            if len(calls) > stop:
                raise OSError("the machine stops")
            return move(spark, source, target)

        monkeypatch.setattr(commit, "moved", broken)
        with pytest.raises(OSError, match="stops"):
            commit.commit(files, jobs, path, "r1")
        assert seen(spark, path) == [] and commit.registrations(spark, path, spark.createDataFrame([("j1", "valid", None)], "job_id string, level string, warnings array<string>")).collect() == []
    monkeypatch.setattr(commit, "moved", move)
    assert commit.commit(files, jobs, path, "r1")
    expected = sorted((r.job_id, r.path, bytes(r.content)) for r in files.collect())
    assert seen(spark, path) == expected and commit.damaged(spark, path).collect() == []
    assert not commit.commit(files.limit(1), jobs, path, "r1") and seen(spark, path) == expected  # it was committed before
    assert [p.name for p in (tmp_path / "b" / "staging").iterdir()] == []


def test_a_later_run_replaces_a_jobs_bundle(spark, tmp_path, bundle):
    files, jobs = bundle
    path = str(tmp_path / "b")
    commit.commit(files, jobs, path, "r1")
    commit.commit(spark.createDataFrame([("j2", "index.md", b"new")], files.schema), jobs, path, "r2")
    rows = seen(spark, path)
    assert [r for r in rows if r[0] == "j2"] == [("j2", "index.md", b"new")] and {r[0] for r in rows} == {f"j{k}" for k in range(6)}
    reports = spark.createDataFrame([("j1", "valid", None), ("j2", "invalid", None), ("j3", "valid_with_warnings", ["w"]), ("x", "valid", None)], "job_id string, level string, warnings array<string>")
    assert sorted(map(tuple, commit.registrations(spark, path, reports).collect())) == [("j1", "bundles/u/j1", "valid", []), ("j3", "bundles/u/j3", "valid_with_warnings", ["w"])]


def test_a_late_cancel_leaves_nothing(spark, tmp_path, bundle):
    """j1 is canceled before the files are written, j4 while they are, j5 while they are written anew."""
    files, jobs = bundle
    asked = []

    def canceled():
        asked.append(1)
        names = ["j1"] + ["j4"] * (len(asked) > 1) + ["j5"] * (len(asked) > 3)
        return spark.createDataFrame([(n,) for n in names], "job_id string")

    path = tmp_path / "b"
    commit.commit(files, jobs, str(path), "r1", canceled)
    left = {"j0", "j2", "j3"}
    assert {r[0] for r in seen(spark, str(path))} == left == {r.job_id for r in spark.read.parquet(str(path / "data")).collect()}
    assert {r.job_id for r in commit.manifests(spark, str(path)).collect()} == left and list((path / "staging").iterdir()) == []


def test_damage_is_found(spark, tmp_path, bundle):
    files, jobs = bundle
    path = str(tmp_path / "b")
    commit.commit(files, jobs, path, "r1")
    whole = spark.read.parquet(f"{path}/data/run=r1").collect()
    spark.createDataFrame([r for r in whole if (r.job_id, r.path) != ("j2", "index.md")], commit.FILES).write.mode("overwrite").parquet(f"{path}/data/run=r1")
    assert [r.job_id for r in commit.damaged(spark, path).collect()] == ["j2"]


def put_jobs(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"id": i, "user_id": "u", "format": "md", "object_key": f"o/{i}", "attempt": a}) for i, a in rows))


def test_messages_go_from_stream_to_stream_once(spark, tmp_path):
    """The first attempt of each delivery fails after it wrote, the driver is lost once after a delivery, and jobs repeat."""
    put_jobs(tmp_path / "jobs", "1.json", [("a", 1), ("b", 1), ("a", 1)])
    tried = []

    def send(batch, path):
        queue.written(batch, path)
        tried.append(path)
        if len(tried) % 2:
            raise OSError("the channel is closed")

    def publish(checkpoint):
        stream = spark.readStream.schema("id string, user_id string, format string, object_key string, attempt int").json(str(tmp_path / "jobs"))
        queue.publish(stream, str(tmp_path / "queue"), str(tmp_path / checkpoint), send=send).awaitTermination()

    def received():
        streams.run_claims(streams.message_stream(spark, str(tmp_path / "queue")), lambda df: df, str(tmp_path / "claims"), str(tmp_path / "dead"), str(tmp_path / "check")).awaitTermination()
        return sorted((r.job_id, r.attempt) for r in spark.read.parquet(str(tmp_path / "claims")).collect())

    publish("sent")
    assert len(tried) == 2 and received() == [("a", 1), ("b", 1)]
    publish("again")  # a checkpoint that was lost: the same micro-batch comes again, and finds itself sent
    assert len(tried) == 2
    put_jobs(tmp_path / "jobs", "2.json", [("b", 1), ("c", 1), ("a", 2)])
    publish("sent")
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "queue")).collect()]
    assert sorted((m["job_id"], m["attempt"]) for m in lines) == [("a", 1), ("a", 2), ("b", 1), ("c", 1)] and len(tried) == 4
    assert [j for j, _ in received()] == ["a", "b", "c"]
    with pytest.raises(OSError, match="never"):
        queue.deliver(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "other"), "1", lambda batch, path: (_ for _ in ()).throw(OSError("never")))
    assert not (tmp_path / "other").exists()


@pytest.mark.parametrize(("most", "most_bytes"), [(3, 1000), (100, 250), (1, 10_000), (5, 90)])
def test_waves_keep_both_bounds(spark, most, most_bytes):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 100)) for k in range(60)]
    found = [w.collect() for w in queue.waves(spark.createDataFrame(rows, "n int, size long").repartition(3), [F.col("n")], F.col("size"), most, most_bytes, 100)]
    assert [r.n for w in found for r in sorted(w)] == list(range(60))
    assert all(len(w) <= most and (sum(r.size for r in w) <= most_bytes or len(w) == 1) for w in found)
    assert len(found) <= 60 // most + 2 + (sum(s for _, s in rows) // (most_bytes - 100) if most_bytes > 100 else 60)
