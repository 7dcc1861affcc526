"""Objects that are listed by tasks and taken once."""

import os

from bindery.sources import files, inbox

DOCS = {"a.md": b"# A", "u1/b.txt": b"B", "u1/deep/er/c.html": b"<p>C", "u2/d.bin": b"D", "u2/_hidden.md": b"no", "u2/.part/e.md": b"no", "u2/e f.md": b"E"}


def put(root, docs):
    for name, data in docs.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)


def keys(objects, root):
    return {r.path.split(f"{root}/")[1] for r in objects.collect()}


def test_listing_as_spark_lists(spark, tmp_path):
    put(tmp_path, DOCS)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        found = inbox.listed(spark, root)
        assert keys(found, tmp_path) == {r.key.replace("%20", " ") for r in files.listing(spark, str(tmp_path)).collect()}
        assert {r.path.split("/")[-1]: r.length for r in found.collect()} == {"a.md": 3, "b.txt": 1, "c.html": 4, "d.bin": 1, "e f.md": 1}
        assert keys(inbox.listed(spark, root, "u1"), tmp_path) == {"u1/b.txt", "u1/deep/er/c.html"}
    assert inbox.listed(spark, str(tmp_path), "gone").count() == 0
    put(tmp_path, {"u4/ñ.md": b""})  # Spark's own listing has no empty files
    assert [(r.name, r.content) for r in inbox.contents(inbox.listed(spark, str(tmp_path), "u4")).collect()] == [("ñ.md", b"")]
    assert inbox.listed(spark, f"file://{tmp_path}/u1").collect()[0].path.startswith("file:///")


def test_contents_of_known_formats_within_the_limit(spark, tmp_path, monkeypatch):
    put(tmp_path, DOCS)
    found = inbox.contents(inbox.listed(spark, str(tmp_path)))
    assert {(r.name, r.format): bytes(r.content) for r in found.collect()} == {("a.md", "md"): b"# A", ("b.txt", "txt"): b"B", ("c.html", "html"): b"<p>C", ("e f.md", "md"): b"E"}
    monkeypatch.setattr(files, "MAX_UPLOAD", 2)
    assert {r.name for r in inbox.contents(inbox.listed(spark, str(tmp_path))).collect()} == {"b.txt", "e f.md"}


def test_runs_take_what_is_new(spark, tmp_path):
    root, manifests = tmp_path / "in", str(tmp_path / "seen")
    put(root, DOCS)
    first = inbox.fresh(spark, str(root), manifests)
    assert first.count() == 5
    # a run that breaks off tells nothing, so the next one has all again
    assert inbox.fresh(spark, str(root), manifests).count() == 5
    put(root, {"late.md": b"late"})
    assert inbox.take(first, manifests, "1") and not inbox.take(first, manifests, "1")
    # what came between the listing and the manifest is not lost
    second = inbox.fresh(spark, str(root), manifests)
    assert keys(second, root) == {"late.md"}
    assert inbox.take(second, manifests, "2")
    put(root, {"u3/new.md": b"new", "a.md": b"# longer"})
    os.utime(root / "u1/b.txt", (1, 1))
    third = inbox.fresh(spark, str(root), manifests)
    assert keys(third, root) == {"u3/new.md", "a.md", "u1/b.txt"}
    assert inbox.take(third, manifests, "3") and inbox.fresh(spark, str(root), manifests).count() == 0
    assert inbox.known(spark, manifests).count() == 5 + 1 + 3


def test_objects_that_change_or_go_before_they_are_read(spark, tmp_path):
    put(tmp_path, {"a.md": b"a", "b.md": b"b", "c.md": b"c"})
    found = inbox.fresh(spark, str(tmp_path), str(tmp_path / "_seen"))
    assert found.count() == 3
    (tmp_path / "a.md").unlink()
    (tmp_path / "b.md").write_bytes(b"bb")
    assert [r.name for r in inbox.contents(found).collect()] == ["c.md"]
