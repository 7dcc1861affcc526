"""Scalar text operators."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bindery.functions import text as X


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_parse_format(spark):
    assert apply(spark, X.parse_format, ".md", ".MD", ".txt", ".html", ".htm", ".pdf", "docx", ".epub", ".markdown", ".text", ".exe", "", "..md") == ["md", "md", "txt", "html", "html", "pdf", "docx", "epub", "md", "txt", None, None, None]


def test_heading_like(spark):
    lines = ["CAPITULO I", "1. Introducción", "1.2 Detalle", "IV. Parte", "Texto normal", "1.", "A B C D E F G H I J.", "ÁÉ 1", "XYZ abc", ""]
    assert apply(spark, X.is_heading_like, *lines) == [True, True, True, True, False, False, False, False, False, False]


def test_promote_headings(spark):
    text = "INTRO\r\n\r\ntexto uno\n\n2. Desarrollo\n\nmás texto\n# YA\n\nNO\nSOLO\n\n" + "A" * 81
    assert apply(spark, X.promote_headings, text, "", "TITULO") == ["# INTRO\n\ntexto uno\n\n# 2. Desarrollo\n\nmás texto\n# YA\n\nNO\nSOLO\n\n" + "A" * 81, "", "# TITULO"]


def test_titles(spark):
    assert apply(spark, X.normalize_text, " Ho­la \t MUNDO\n") == ["hola mundo"]
    assert apply(spark, X.clean_title, " a \n b ", "é" * 60, "x" * 120) == ["a b", "é" * 50, "x" * 100]
    assert apply(spark, X.clean_line, "a​b  c \t") == ["ab  c"]


def test_collapse_hyphens(spark):
    assert apply(spark, X.collapse_hyphens, "pala-\nbra", "a-/bc-/de x".replace("/", "\n"), "Nuevo-\nTema", "x\\-\nab", "so­\n  ftwar") == ["palabra", "abcde x", "Nuevo-\nTema", "x\\-\nab", "softwar"]


def test_asset_names(spark):
    assert apply(spark, X.sanitize_asset_name, "Foto Final.PNG", "a/b/c.png", "imagen_1.jpeg", "árbol.png", "///") == ["foto-final.png", "a-b-c.png", "imagen_1.jpeg", "rbol.png", ""]
    assert apply(spark, X.is_remote_ref, "http://x", "HTTPS://x", "data:x", "//x", "img/x", "/x") == [True, True, True, True, False, False]


def test_rewrite_images(spark):
    names = F.create_map(F.lit("a.png"), F.lit("b.png"))
    got = apply(spark, lambda c: X.rewrite_images(c, names), '![x](a.png "t") ![y](http://a.png) ![z](c.png)', "none", "")
    assert got == ['![x](../assets/b.png "t") ![y](http://a.png) ![z](c.png)', "none", ""]


def test_users(spark):
    assert apply(spark, X.valid_email, "a@b.c", "a@b", "a b@c.d", "@b.c") == [True, False, False, False]
    assert apply(spark, X.valid_password, "12345678", "éééé", "short") == [True, True, False]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aA1. #\n-=é", max_size=60), min_size=1, max_size=5))
def test_promotion_only_adds_marks(spark, texts):
    for text, out in zip(texts, apply(spark, X.promote_headings, *texts), strict=True):
        before, after = text.split("\n"), out.split("\n")
        assert len(before) == len(after)
        assert all(b == a or a == "# " + b.strip() for b, a in zip(before, after, strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_cut_bytes(spark, n):
    for text, got in zip(["aé日😀b"] * 1 + ["", "ab"], apply(spark, lambda c: X.cut_bytes(c, n), "aé日😀b", "", "ab"), strict=True):
        want = text
        while len(want.encode()) > n:
            want = want[:-1]
        assert got == want
