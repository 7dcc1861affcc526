"""Archives by members against the standard library's reader."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from bindery.operators import exports

FILES = [("j", "b/ñ.md", "# Uno\n" * 500), ("j", "a.md", ""), ("j", "c.bin", None), ("k", "log.md", "x"), ("lost", "a", "b")]


def parts(spark, rows, **options):
    files = spark.createDataFrame(rows, "job_id string, path string, content string").withColumn("content", F.col("content").cast("binary"))
    jobs = spark.createDataFrame([("j", "mi.libro.pdf"), ("k", "k.md"), ("none", "n.md")], "job_id string, original_name string")
    return exports.archive_parts(files, jobs, **options)


@pytest.mark.parametrize("level", [0, 6])
def test_parts_are_a_zip_file(spark, level):
    found = parts(spark, FILES, level=level)
    data = b"".join(exports.streamed(found, "j"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        assert {n: z.read(n) for n in z.namelist()} == {"a.md": b"", "b/ñ.md": b"# Uno\n" * 500, "c.bin": b""}
    rows = found.orderBy("job_id", "ord").collect()
    assert [(r.job_id, r.name, r.ord, r.path) for r in rows][:4] == [("j", "mi.libro-bindery.zip", k + 1, p) for k, p in enumerate(["a.md", "b/ñ.md", "c.bin", None])]
    assert {r.job_id for r in rows} == {"j", "k"} and (len(data) > 3000) == (level == 0)
    assert list(exports.streamed(found, "none")) == []
    back = {(r.job_id, r.path): bytes(r.content) for r in exports.members_of(found).collect()}
    assert back == {(j, p): (c or "").encode() for j, p, c in FILES if j != "lost"}


def test_equal_paths_and_no_files(spark):
    data = b"".join(exports.streamed(parts(spark, [("j", "a", "1"), ("j", "a", "1"), ("j", None, "2")]), "j"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == ["a", "a"]
    assert parts(spark, []).count() == 0


def test_more_members_than_the_short_fields_tell(spark):
    n = exports.MOST_MEMBERS + 5
    files = spark.range(n).select(F.lit("j").alias("job_id"), F.format_string("%06d", "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    jobs = spark.createDataFrame([("j", "j.md")], "job_id string, original_name string")
    data = b"".join(exports.streamed(exports.archive_parts(files, jobs, level=0), "j"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert len(z.namelist()) == n and z.read(f"{n - 1:06d}") == str(n - 1).encode()


def test_places_beyond_four_gigabytes(spark):
    """Records at such places, without the bytes before them."""
    at, n, size = 1 << 33, 3, 200
    hexed = spark.range(1).select(exports.ending(F.lit(n), F.lit(at), F.lit(size)).alias("h")).first().h
    raw = bytes.fromhex(hexed)
    assert len(raw) == exports.END64_BYTES + 20 + exports.END_BYTES
    assert int.from_bytes(raw[48:56], "little") == at and int.from_bytes(raw[64:72], "little") == at + size
    assert raw[-6:-2] == b"\xff" * 4 and int.from_bytes(raw[-12:-10], "little") == n


def test_a_broken_part_is_an_error(spark):
    found = parts(spark, [("j", "a", "text"), ("j", "b", "texts")], level=0)
    broken = found.withColumn("part", F.expr("concat(substring(part, 1, octet_length(part) - 1), X'00')"))
    with pytest.raises(Exception, match="isn't what its record says"):
        exports.members_of(broken).collect()
