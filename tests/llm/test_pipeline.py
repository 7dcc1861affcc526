"""The pipeline's stages against what each of them promises, and the queries against their SQL."""

import zlib

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bindery.llm.common import TABLES, stored

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stored(stage(spark, docs, DATA))
        if k < 4:
            assert docs.columns == columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) == docs.count()
            kept.append(ids)
        if k == 1:
            texts = [r.text for r in docs.collect()]
            assert len(set(texts)) == len(texts) == len({r.text for r in before.collect()})
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == kept[-1] and len(kept[0]) < 200
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


@pytest.mark.parametrize("name", ["op3_license_scan", "op4_source_mixing", "op6_ngram_jaccard_join", "op7_exact_dedup", "op11_importance_resampling", "op13_hard_negatives", "alike_documents"])
def test_queries_agree_with_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, DATA)
    sql = db.sql(__spark_entry__.oracle_sql()[name])
    order = sorted(found.columns)
    assert sorted(sql.columns) == order
    rows = sorted((tuple(r[c] for c in order) for r in found.collect()), key=str)
    assert rows == sorted((tuple(r[sql.columns.index(c)] for c in order) for r in sql.fetchall()), key=str)


def test_contracts(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, fold in (("op2_quality_classifier", (4, 2)), ("op8_toxicity", (3, 1))):
        rows = __spark_entry__.queries()[name](spark, DATA).collect()
        assert len(rows) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) for r in rows)


ODD = [
    (1, None, None, None, None), (2, "", "en", "src1", 0), (3, "x" * 100_000, "en", None, 5), (4, "plain words here", None, "src2", 3), (4, "plain words here", None, "src2", 3),
    (None, "plain words here", "de", "other", None), (None, None, None, None, None), (5, "word " * 5000, "fr", "src7", 1), (6, "plain words here too", "de", "src19", 1),
]


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_bear_odd_rows(spark, k, rows):
    extra = "score double, kept string, node long, component_id string, digest string, label string, units string"
    docs = spark.createDataFrame([(*r, *[None] * 7) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    out = corpus_pipeline.STAGES[k][1](spark, docs, DATA)
    found = out.collect()
    if k < 4:
        assert out.columns == docs.columns and len(found) <= len(rows)
    if k == 1 and rows:
        assert sorted(r.text or "" for r in found) == sorted({r[1] or "" for r in rows})
    if k == 4:
        assert sum(r.length for r in found) >= len(rows)


@pytest.mark.parametrize("k", range(4))
def test_names_that_differ_in_case_only(spark, k):
    """Names that a stage would give its own columns, in other letters: they come out of it with their values."""
    names = ["ROW_0", "Row_1", "SAME_0", "Kept_Row", "KEPT", "_KEEP_ID", "Component_Id", "PREDICTED", "Node", "Digest", "At_0"]
    texts = ["plain words here", "plain words here", "", None, "word " * 500, "other words stand here " * 3]
    rows = [(i % 5, t, "en", "src1", i, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    out = corpus_pipeline.STAGES[k][1](spark, docs, DATA)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= set(rows)


def test_run_leaves_one_table(spark):
    before = len(TABLES)
    pieces = corpus_pipeline.run(spark, DATA)
    assert len(TABLES) == before + 1 and pieces.count() > 100


def test_rows_that_share_an_id_are_decided_for_by_themselves(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in __spark_entry__.queries()["op2_quality_classifier"](spark, DATA).collect()}
    good, bad = (next(r for r in docs.orderBy("doc_id").collect() if scores[r.doc_id] == k and r.text) for k in (1, 0))
    shared = spark.createDataFrame([(7, good.text), (7, bad.text), (None, good.text), (None, bad.text)], "doc_id long, text string")
    shared = docs.filter("doc_id <> 7").unionByName(shared.withColumns({"lang": F.lit("en"), "source": F.lit("src1"), "n_chars": F.length("text")}))
    out = stages["quality"](spark, shared, DATA).filter("doc_id = 7 OR doc_id IS NULL").collect()
    assert sorted((str(r.doc_id), r.text == good.text) for r in out) == [("7", True), ("None", True)]

    words = [f"word{i}" for i in range(60)]
    near, near2, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"other{i}" for i in range(60))
    rows = [(7, near, 1), (7, near2, 2), (7, other, 3), (None, near2 + " more", 4), (None, "", 5), (None, None, 6), (9, near, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row_0 long").withColumns({"lang": F.lit("en"), "source": F.lit("src1"), "n_chars": F.length("text")})
    out = stages["near copies"](spark, table, DATA)
    assert sorted(r.row_0 for r in out.collect()) == [3, 4, 5, 6] and out.columns == table.columns
    exact = stages["exact copies"](spark, table, DATA).collect()
    assert sorted(r.row_0 for r in exact)[:3] == [2, 3, 4] and len(exact) == 5 and 7 in {r.row_0 for r in exact}
    assert {r.row_0 for r in stages["mixture"](spark, table, DATA).collect()} <= set(range(1, 8))
    pieces = stages["packing"](spark, table, DATA).collect()
    assert sum(r.doc_id is None for r in pieces) >= 3
