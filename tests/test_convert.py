"""The main path over all six formats."""

from pyspark.sql import functions as F
from test_sources import CHAPTERS, DOCX, NCX, pdf_file, zipped

from bindery.plans import convert


def some_docs(spark):
    pages = pdf_file([[(20, 50, 700, "Uno"), (11, 50, 660, "texto uno"), (11, 50, 640, "y más")], [(20, 50, 700, "Dos"), (11, 50, 660, "texto dos"), (11, 50, 640, "y más")]])
    rows = [
        ("md", "md", b"# A\n\nuno dos\n\n# B\n\ntres cuatro\n"), ("txt", "txt", "INTRO\n\ntexto uno\n\n2. Parte\n\ntexto dos\n".encode()), ("html", "html", b"<h1>A</h1><p>x y</p><h1>B</h1><p>z w</p>"),
        ("docx", "docx", zipped(DOCX)), ("epub", "epub", zipped({**CHAPTERS, "O/toc.ncx": NCX})), ("pdf", "pdf", pages), ("bad", "docx", b"junk"), ("exe", "exe", b"x"), ("gone", "md", b"# x"), ("odd", "txt", b"\xff\xfe"),
    ]
    return spark.createDataFrame(rows, "job_id string, format string, content binary").withColumns({"original_name": F.concat_ws(".", "job_id", "format"), "converted_at": F.lit("2024-01-01").cast("timestamp")})


def test_all_formats(spark):
    parts = convert.convert(some_docs(spark).withColumnRenamed("job_id", "doc_id"))
    titles = {}
    for r in sorted(parts.segments.collect(), key=lambda r: r.ord):
        titles.setdefault(r.doc_id, []).append(r.title)
        assert r.body.startswith("#") and r.body.endswith("\n")
    assert titles == {"md": ["A", "B"], "txt": ["INTRO", "2. Parte"], "html": ["A", "B"], "docx": ["Uno"], "epub": ["Primero", "Capítulo 2"], "pdf": ["Uno", "Dos"], "gone": ["x"], "odd": ["Documento completo"]}
    assert {r.doc_id for r in parts.errors.collect()} == {"bad", "exe"}
    bodies = {(r.doc_id, r.ord): r.body for r in parts.segments.collect()}
    assert "![](../assets/i.png)" in bodies["docx", 1] and "](../assets/a.png)" in bodies["epub", 1]


def test_publish(spark, tmp_path):
    out = convert.publish(some_docs(spark), spark.createDataFrame([("gone",)], "job_id string"))
    levels = {r.job_id: (r.level, r.err) for r in out.reports.collect()}
    assert levels.pop("odd")[0] == "valid" and set(levels) == {"md", "txt", "html", "docx", "epub", "pdf"} and all(x[0] != "invalid" for x in levels.values())
    paths = {(r.job_id, r.path) for r in out.files.collect()}
    assert ("epub", "assets/a.png") in paths and ("docx", "assets/i.png") in paths and ("pdf", "conceptos/fragmento-02.md") in paths and not [p for p in paths if p[0] in ("gone", "bad", "exe")]
    convert.write_bundles(out.files, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("job_id = 'md'").count() == 4
    jobs = some_docs(spark).select("job_id", F.when(F.col("job_id").isin("md", "txt"), "u1").otherwise("u2").alias("user_id"))
    late = spark.createDataFrame([("txt",)], "job_id string")
    convert.write_bundles(out.files, str(tmp_path / "users"), jobs, late)
    written = spark.read.parquet(str(tmp_path / "users"))
    assert {(r.user_id, r.job_id) for r in written.select("user_id", "job_id").distinct().collect()} >= {("u1", "md"), ("u2", "pdf")} and written.filter("job_id = 'txt'").count() == 0
    found = {r.job_id: r.path for r in convert.register(out, jobs, str(tmp_path / "users")).collect()}
    assert found["md"] == "bundles/u1/md" and "txt" not in found and "bad" not in found
