"""Operator 1 by lines and paragraphs against a loop over all of them, and the query against its SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bindery.llm.line_hashing import line_dedup

SCHEMA = "doc_id long, text string, Digest string, n int, `end` int, start int, words string, `first` int, later string"
A, B, C = "Uno dos tres, cuatro cinco.", "one TWO three four", "solo tres palabras"
TEXTS = [
    None, "", " \n\n \n", "!!!\n???", A, f"{A}\n{B}\n{A}", f"x y\n{B.lower()}!\nlast line that stays here", f"{C}\n{C}", f"{A}\n\n{B}\n \n{C}\n\n\n{C}\n", f"{B}\r\n{A}\r\n",
    "\n".join(f"line {k % 700} of a long text" for k in range(2000)), "é日本 語 one two\n" * 3, f"{A}\n{B}", f"{A}\n{B}", "x" * 100_000, "😀 four words with emoji 😀\n😀 four words with emoji",
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "d", 1, 2, 3, "w", 4, "l") for i, t in rows], SCHEMA).repartition(3)


def by_hand(rows, kind, least):
    """doc_id, text, n_removed, removed; rows ordered as their ids, which differ, are."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        pieces = re.findall(r"[^\n]*\n|[^\n]+" if kind == "line" else r"(?:(?!\n[ \t\r]*\n).)*?\n(?:[ \t\r]*\n)+|.+", text or "", re.S)
        at, stay, spans, n = 0, "", [], 0
        for p in pieces:
            key = tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), p)))
            if len(key) >= least and key in seen:
                n, spans = n + len(key), [*spans, (at, at + len(p))]
            else:
                stay += p
                seen |= {key}
            at += len(p)
        out.append((i, stay if text else text, n, spans))
    return out


@pytest.mark.parametrize(("kind", "least"), [("line", 4), ("line", 1), ("paragraph", 4)])
def test_units_by_hand(spark, kind, least):
    rows = [*enumerate(TEXTS), (None, f"first of all\n{C} y cuatro")]
    found = line_dedup(docs(spark, rows), kind, least).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed, [tuple(s) for s in r.removed]) for r in found), key=lambda r: -1 if r[0] is None else r[0]) == by_hand(rows, kind, least)
    for r in found:
        original, at, kept = dict(rows)[r.doc_id] or "", 0, ""
        for start, end in r.removed:
            kept, at = kept + original[at:start], end
        assert kept + original[at:] == (r.text or "")


def test_repeated_rows_and_no_rows(spark):
    rows = [(7, f"{A}\n{B}"), (7, f"{A}\n{B}"), (9, A), (None, B), (None, B)]
    found = line_dedup(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in found) == [("7", f"{A}\n", 4), ("7", f"{A}\n", 4), ("9", "", 5), ("None", B, 0), ("None", B, 0)]
    assert line_dedup(docs(spark, rows).limit(0)).count() == 0


def test_a_hot_line_stays_where_it_lies(spark):
    """A line that half of all rows have: its rows go by the broadcast side, and each but the first loses it."""
    n = 4000
    text = F.when(F.col("id") % 2 == 0, F.lit(f"{A}\n")).otherwise("").cast("string")
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(text, F.lit("own line of number "), F.col("id").cast("string")).alias("text"))
    found = line_dedup(rows)
    assert found.filter("n_removed > 0").count() == n // 2 - 1 and found.filter("doc_id = 0").first().n_removed == 0


def test_the_query_and_its_sql(spark):
    at = "/root/testdata/sf0.001"
    found = __spark_entry__.queries()["repeated_lines"](spark, at)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    sql = con.sql(__spark_entry__.oracle_sql()["repeated_lines"])
    assert sorted(sql.columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*sql.columns).collect())) == sorted(sql.fetchall())
    assert found.filter("n_removed > 0").count() > 0
