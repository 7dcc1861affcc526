"""Documents that would take all memory or time are errors, and the others go on."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from bindery.functions import guard
from bindery.operators import assets
from bindery.plans.convert import convert
from bindery.sources import archives, html


def bomb(megabytes):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b" " * (megabytes << 20))
    return out.getvalue()


def test_inflated_stops():
    assert guard.inflated(zlib.compress(b"x" * 1000), 1000) == b"x" * 1000
    with pytest.raises(ValueError, match="over 999 bytes"):
        guard.inflated(zlib.compress(b"x" * 1000), 999)
    with zipfile.ZipFile(io.BytesIO(bomb(1))) as z, pytest.raises(ValueError, match="inflated"):
        guard.members(z, 1000)


def test_a_deflate_bomb_is_an_error_row(spark):
    data = bomb(450)
    assert len(data) < 1 << 20
    docs = spark.createDataFrame([("bomb", "docx", data), ("page", "html", b"<h1>A</h1><p>b</p>")], "doc_id string, format string, content binary")
    found = convert(docs)
    errors = {r.doc_id: r.error for r in found.errors.collect()}
    assert set(errors) == {"bomb"} and "inflated" in errors["bomb"]
    assert {r.doc_id for r in found.segments.collect()} == {"page"}
    assert [r.kind for r in archives.parsed(docs.filter("doc_id = 'bomb'")).collect()] == ["error"]


def test_a_slow_page_is_an_error(spark):
    pages = spark.createDataFrame([(1, "<p>fast</p>"), (2, "<ul>" + "<li><p>a</p>" * 200_000)], "n int, html string")
    rows = {r.n: r.page for r in pages.select("n", html.converted(F.col("html"), 0.05).alias("page")).collect()}
    assert rows[1].markdown == "fast" and rows[1].error is None and rows[2].markdown is None and "over" in rows[2].error


def test_asset_cap_counts_contents(spark):
    rows = [("d", k, f"{k}.png", bytes([k % 3 if k < 10 else k])) for k in range(20)] + [("e", 0, "x", b"x")]
    found = assets.capped_assets(spark.createDataFrame(rows, "doc_id string, ord int, src string, content binary"), 5).collect()
    assert sorted(r.ord for r in found if r.doc_id == "d") == list(range(12)) and sum(r.doc_id == "e" for r in found) == 1
