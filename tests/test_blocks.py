"""Headings among quotes, lists, fences and HTML blocks."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bindery.functions.blocks import headings
from bindery.operators import segments


def titles(text, deepest=2):
    return [t for _, t in headings(text, deepest)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# A\n\ntext\n## B ##\n### C\n#no\n####### no\n#\n", ["A", "B", ""]),
        ("<pre>\n# no\n\n# no\n</pre>\n# yes", ["yes"]),
        ("<!-- a\n\n# no\n--> b\n# yes\n<!-- one line -->\n# too", ["yes", "too"]),
        ("<div>\n# no\n\n# yes\n\n</section>\n# no\n", ["yes"]),
        ("text\n<b>\n# yes\n\n<b>\n# no\n\n# too", ["yes", "too"]),
        ("<?php\n# no\n?>\n<![CDATA[\n# no\n]]>\n<!DOCTYPE\n# no\n>\n# yes", ["yes"]),
        ("<textarea>\n\n# no", []),
        ("A\n===\n\nB\nb\n---\n\n---\n\n- - -\n# C", ["A", "B\nb", "C"]),
        ("> # A\n> B\n> ===\n>> # C\n", ["A", "B", "C"]),
        ("> text\n===\n", []),  # a lazy line can't underline
        ("> text\nlazy\n> ---\n", ["text\nlazy"]),
        ("> ```\n> # no\n# yes\n", ["yes"]),  # a fence ends with its quote
        ("- # A\n- B\n  ===\n1. # C\n   1. # D\n", ["A", "B", "C", "D"]),
        ("- ```\n  # no\n  ```\n  # yes\n", ["yes"]),
        ("- item\n\n      # no, code\n\n  # yes\n\n# too", ["yes", "too"]),
        ("- item\n    # yes\n", ["yes"]),
        ("* a\n\n\n  # yes\n-\n  # too\n", ["yes", "too"]),
        ("text\n2. # no\n\n2. # yes", ["yes"]),
        ("    # no\n\ttext\n\t# no\n\n-\t# yes", ["yes"]),
        ("````\n# no\n```\n# no\n````\n~~~ x`\n# no\n~~~~\n# yes\n``` a`b\n# too", ["yes", "too"]),
        ("```\n# no", []),
        ("a\n***\nb\n* * *\n# C", ["C"]),
        ("", []),
    ],
)
def test_headings(text, expected):
    assert titles(text) == expected


def test_lines_and_levels():
    assert headings("a\n\nb\nc\n--\n# d\n### e") == [(2, "b\nc"), (5, "d")]
    assert headings("a\n=\n\nb\n-\n### e", 3) == [(0, "a"), (3, "b"), (5, "e")] and headings("a\n=\n\nb\n-", 1) == [(0, "a")]


@pytest.mark.parametrize("line", ["> quoted line", "> > a\n> b", "> - a", "- a", "text", "<div>", "<!-- ", "> ```", "-", ">", "    x\n\n", "1. a\n   2. b\n", "=", "<b"])
def test_time_grows_with_the_lines(line):
    began = time.perf_counter()
    headings((line + "\n") * 100_000)
    assert time.perf_counter() - began < 5


def test_quoted_megabytes_in_spark(spark):
    docs = spark.createDataFrame([(1, "> a quoted line\n" * 100_000 + "\n# End\n"), (2, "# A\n" * 20_000)], "doc_id int, text string")
    began = time.perf_counter()
    rows = segments.segments(docs).groupBy("doc_id").count().collect()
    assert sorted(map(tuple, rows)) == [(1, 1), (2, 20_000)] and time.perf_counter() - began < 20


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#>-=`~<!a1.* \t\n", max_size=80))
def test_starts_increase(text):
    found = headings(text)
    assert all(a < b for (a, _), (b, _) in zip(found, found[1:], strict=False)) and all(0 <= n < len(text.split("\n")) for n, _ in found)
