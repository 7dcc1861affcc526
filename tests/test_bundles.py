"""Segments, assets, bundles and their validation."""

import io
import zipfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bindery.operators import assets, bundles, segments, validation


def cut(spark, *texts):
    rows = segments.segments(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    return [[(r.title, r.body) for r in sorted(rows, key=lambda r: r.ord) if r.doc_id == i] for i in range(len(texts))]


def test_structured_markdown(spark):
    text = "# Uno\n\ncuerpo uno\n\n## Dos\n\ncuerpo dos\n\n# Tres\n\n- a\n- b\n"
    assert cut(spark, text) == [[("Uno", "# Uno\n\ncuerpo uno\n"), ("Dos", "## Dos\n\ncuerpo dos\n"), ("Tres", "# Tres\n\n- a\n- b\n")]]


def test_texts_without_headings(spark):
    assert cut(spark, "solo texto", "", "### menor") == [[("Documento completo", f"# Documento completo\n\n{b}\n")] for b in ("solo texto", "", "### menor")]


def test_prelude_untitled_and_marks(spark):
    got = cut(spark, "antes\n\n# **Uno** [enlace](http://x) #\ntexto\n#\nvacío")[0]
    assert got == [("Uno enlace", "# Uno enlace\n\nantes\n\n# **Uno** [enlace](http://x) #\ntexto\n"), ("Sección 2", "#\nvacío\n")]


def test_fences_setext_and_boxes(spark):
    fenced = "# A\n```\n# no\n```\n~~~\n## no\n~~~\n# B\n"
    assert [t for t, _ in cut(spark, fenced)[0]] == ["A", "B"]
    assert [t for t, _ in cut(spark, "Uno\n===\ntexto\n\nDos\nlíneas\n---\n\nfin\n\n---\n")[0]] == ["Uno", "Dos\nlíneas"]
    assert [t for t, _ in cut(spark, "> # Cita\n\n- ## Lista\n\n#sin\n")[0]] == ["Cita", "Lista"]


def test_long_fences_quotes_and_long_headings(spark):
    titles = lambda text: [t for t, _ in cut(spark, text)[0]]
    assert titles("# A\n````\n```\n# no\n````\n# B\n") == ["A", "B"]
    assert titles("# A\n> ```\n> # no\n> ```\n# B\n") == ["A", "B"]
    assert titles("# A\n> ~~~\n> # no\n\n# B\n") == ["A", "B"]  # a quoted fence ends with its quote
    assert titles("> Cita\n> ===\n\ntexto\n") == ["Cita"] and titles("> > Dos\n> > ---\n") == ["Dos"]
    long = "\n".join(f"línea {i}" for i in range(150))
    assert titles(f"{long}\n===\nfin\n") == [long]
    assert titles("> " * 60 + "# hondo\n") == ["hondo"]


def test_resolved_paths(spark):
    paths = {"conceptos/a/b/c/d/e/../../../../../../assets/x.png": "assets/x.png", "a/./b//c": "a/b/c", "../x": "../x", "a/../../b": "../b", "../../c/..": "../..", "": "", "a/..": "", "...": "..."}
    found = spark.createDataFrame(list(paths.items()), "path string, expected string").select("expected", validation.resolved(F.col("path")).alias("got")).collect()
    assert all(r.got == r.expected for r in found), found


def test_long_texts(spark):
    many = "\n\n".join(f"# t{i}\n\n" + "línea de texto\n" * 30 for i in range(400))
    assert len(cut(spark, many, "- " * 50_000, "x" * 300_000, "a\n" * 50_000)[0]) == 400


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab# \n`", max_size=80), min_size=1, max_size=4))
def test_segments_keep_all_text(spark, texts):
    for text, got in zip(texts, cut(spark, *texts), strict=True):
        letters = lambda s: "".join(c for c in s if c in "ab")
        bodies = "".join(b for _, b in got)
        assert letters(text) in letters(bodies) or all(c in bodies for c in letters(text))
        assert all(b.startswith("#") and b.endswith("\n") for _, b in got)


def some_assets(spark, rows):
    return spark.createDataFrame([(d, i, s, c.encode()) for i, (d, s, c) in enumerate(rows)], "doc_id string, ord int, src string, content binary")


def test_assets(spark):
    rows = [("d", "a/Foto.png", "1"), ("d", "b/foto.PNG", "2"), ("d", "c/other.png", "1"), ("e", "x/Foto.png", "1"), ("d", "///", "3"), ("d", "q/..", "4")]
    names = {(r.doc_id, r.src): r.name for r in assets.asset_names(some_assets(spark, rows)).collect()}
    assert names["d", "a/Foto.png"] == names["d", "c/other.png"] == "foto.png" and names["e", "x/Foto.png"] == "foto.png"
    assert names["d", "b/foto.PNG"].startswith("foto-") and names["d", "b/foto.PNG"].endswith(".png") and len(names["d", "b/foto.PNG"]) == 17
    assert names["d", "///"] == "asset"
    assert assets.distinct_assets(some_assets(spark, rows)).filter("doc_id = 'd'").count() == 4


def test_relink_stays_within_the_archive(spark):
    found = some_assets(spark, [("d", "img/x.png", "1"), ("d", "/etc/passwd", "2"), ("d", "../up.png", "3")])
    body = "![a](img/x.png) ![b](/etc/passwd) ![c](../up.png) ![d](gone.png)"
    out = assets.relink(spark.createDataFrame([("d", 1, body), ("e", 1, "![a](img/x.png)")], "doc_id string, ord int, body string"), found)
    assert {r.doc_id: r.body for r in out.collect()} == {"d": "![a](../assets/x.png) ![b](/etc/passwd) ![c](../up.png) ![d](gone.png)", "e": "![a](img/x.png)"}
    assert assets.local_references(out).count() == 5


def test_segments_take_the_names_they_show(spark, monkeypatch):
    """A document of many assets: each segment's map holds what it shows, not the whole document's names."""
    from pyspark.sql import functions as F

    found = some_assets(spark, [("d", f"img/{k}.png", str(k)) for k in range(40)])
    of = spark.createDataFrame([("d", k, f"![a](img/{k}.png) ![b](img/{k}.png) ![c](gone.png)") for k in range(40)] + [("d", 40, "x")], "doc_id string, ord int, body string")
    held, real = [], assets.rewrite_images
    monkeypatch.setattr(assets, "rewrite_images", lambda body, names: held.append(1) or F.concat(real(body, names), F.format_string(" %d", F.size(names))))
    rows = {r.ord: r.body for r in assets.relink(of, found).collect()}
    assert held and rows == {k: f"![a](../assets/{k}.png) ![b](../assets/{k}.png) ![c](gone.png) 1" for k in range(40)} | {40: "x 0"}


def built(spark):
    of = spark.createDataFrame([("j", 2, "B|c", "# B\n\ndos tres\n"), ("j", 1, "A", "# A\n\nuno dos\n")], "job_id string, ord int, title string, body string")
    jobs = spark.createDataFrame([("j", "doc.md", "md", b"abc")], "job_id string, original_name string, format string, content binary").withColumn("converted_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    named = spark.createDataFrame([("j", "x.png", b"png")], "job_id string, name string, content binary")
    return bundles.bundle_files(of, jobs, named), jobs


def test_build(spark):
    files, jobs = built(spark)
    found = {r.path: bytes(r.content).decode() for r in files.collect()}
    assert sorted(found) == ["assets/x.png", "conceptos/fragmento-01.md", "conceptos/fragmento-02.md", "index.md", "log.md"]
    assert found["index.md"].splitlines()[-2:] == ["| 1 | A | [fragmento-01.md](conceptos/fragmento-01.md) |", "| 2 | B\\|c | [fragmento-02.md](conceptos/fragmento-02.md) |"]
    assert "- **Tamaño (bytes):** 3\n- **Conceptos generados:** 2\n- **Recursos extraídos:** 1\n- **Fecha de conversión:** 2024-01-02T03:04:05Z" in found["log.md"]
    text = files.withColumn("content", F.decode("content", "UTF-8"))
    report = validation.reports(text, jobs).collect()
    assert [(r.level, r.warnings, r.err) for r in report] == [("valid", [], None)]
    archive = bundles.archives(files, jobs).collect()[0]
    assert archive.name == "doc-bindery.zip" and sorted(zipfile.ZipFile(io.BytesIO(archive.archive)).namelist()) == sorted(found)
    assert bundles.export_file(files, "j", "../log.md").count() == 0 and bundles.export_file(files, "j", "log.md").count() == 1


BASE = {"index.md": "[a](conceptos/a.md)", "log.md": "SHA-256 Formato Conceptos generados", "conceptos/a.md": "# A\n\nuno dos"}


def report(spark, **changes):
    files = {k: v for k, v in {**BASE, **changes}.items() if v is not None}
    rows = spark.createDataFrame([("j", p, c) for p, c in files.items()], "job_id string, path string, content string")
    r = validation.reports(rows, spark.createDataFrame([("j",)], "job_id string")).collect()[0]
    return r.level, r.warnings, r.err


def test_validation(spark):
    assert report(spark) == ("valid", [], None)
    assert report(spark, **{"index.md": None}) == ("invalid", [], "bundle incompleto: falta index.md")
    assert report(spark, **{"log.md": None}) == ("invalid", [], "bundle incompleto: falta log.md")
    assert report(spark, **{"conceptos/a.md": None})[0] == "invalid"
    assert report(spark, **{"conceptos/a.md": None, "conceptos/a.txt": "x"})[2] == "bundle inválido: conceptos/ vacío"
    assert report(spark, **{"index.md": "[a](conceptos/a.md) [b](conceptos/b.md) [w](http://x)"})[2] == 'link roto en index.md: "conceptos/b.md"'
    assert report(spark, **{"conceptos/b.md": "# B\n\nuno dos"})[1] == ['el concepto "b.md" no está enlazado desde index.md']
    assert report(spark, **{"conceptos/a.md": "uno"})[1] == ['el concepto "a.md" no empieza con un encabezado', 'el concepto "a.md" casi no tiene contenido']
    assert report(spark, **{"conceptos/a.md": " \n"})[1] == ['el concepto "a.md" está vacío']
    assert report(spark, **{"log.md": "SHA-256"})[1] == ['log.md sin el campo de trazabilidad "Formato"', 'log.md sin el campo de trazabilidad "Conceptos generados"']
    image = {"conceptos/a.md": "# A\n\nuno ![i](../assets/x.png) ![r](https://x/y.png)"}
    assert report(spark, **image) == ("valid_with_warnings", ['el concepto "a.md" referencia un recurso inexistente: "../assets/x.png"'], None)
    assert report(spark, **image, **{"assets/x.png": "png"}) == ("valid", [], None)


def test_warnings_are_ordered(spark):
    found = report(spark, **{"index.md": "[a](conceptos/b.md)", "conceptos/b.md": "texto de b ![i](no.png)", "conceptos/c.md": "", "log.md": "SHA-256 Formato"})[1]
    assert found == [
        'el concepto "a.md" no está enlazado desde index.md', 'el concepto "c.md" no está enlazado desde index.md', 'el concepto "b.md" no empieza con un encabezado', 'el concepto "c.md" está vacío',
        'el concepto "b.md" referencia un recurso inexistente: "no.png"', 'log.md sin el campo de trazabilidad "Conceptos generados"',
    ]


def test_a_job_without_files_is_invalid(spark):
    none = spark.createDataFrame([], "job_id string, path string, content string")
    assert validation.reports(none, spark.createDataFrame([("j",)], "job_id string")).collect()[0].err == "bundle incompleto: falta index.md"
