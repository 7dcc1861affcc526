"""Readers of uploads, HTML, DOCX, EPUB and PDF, and the PDF line model."""

import io
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from bindery.functions.guard import limited
from bindery.operators import pdf_model
from bindery.plans import convert
from bindery.sources import archives, files, html, pdf


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_html():
    text = "<html><head><title>t</title><style>p{}</style></head><body><h1>Uno</h1><p>a <b>b</b> <a href='x'>c</a><br>d</p><ul><li>1<li>2</ul><ol><li>x</li></ol><script>no()</script><h2>Dos</h2><img src='i.png' alt='I'><blockquote>q</blockquote><pre>a\n  b</pre><table><tr><th>A<th>B</tr><tr><td>1</td><td>2</td></tr></table>&amp;"
    got = html.to_markdown(text)
    for part in ("# Uno\n\na **b** [c](x)  \nd", "- 1\n- 2", "1. x", "## Dos\n\n![I](i.png)", "> q", "```\na\n  b\n```", "| A | B |\n| --- | --- |\n| 1 | 2 |", "&"):
        assert part in got, (part, got)
    assert "no()" not in got and "p{}" not in got and html.to_markdown(None) == "" and html.to_markdown("<p") is not None


def test_html_column(spark):
    rows = spark.createDataFrame([("<h1>A <i>b</i></h1><a href='no'></a><a class='k' href=\"y\">z</a>",), (None,)], "h string").select(html.html_to_markdown(F.col("h")).alias("m"), html.page_title(F.col("h")).alias("t"), html.page_links(F.col("h")).alias("l")).collect()
    assert rows[0].m.startswith("# A _b_") and rows[0].t == "A b" and rows[0].l == ["y"] and rows[1].m == ""


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DOCX = {
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Uno</w:t></w:r></w:p><w:p><w:r><w:t>texto </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>fuerte</w:t></w:r></w:p><w:p><w:r><w:drawing><a:blip r:embed="r1"/></w:drawing></w:r></w:p></w:body></w:document>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="media/i.png"/></Relationships>', "word/media/i.png": "png",
}
CHAPTERS = {"O/c1.xhtml": "<h1>C1</h1><img src='img/a.png'>", "O/c2.xhtml": "<p>dos</p>", "O/img/a.png": "png", "O/cover.xhtml": "<p>no</p>"}
NCX = '<ncx xmlns="x"><navMap><navPoint><navLabel><text>Primero</text></navLabel><content src="c1.xhtml"/><navPoint><navLabel><text> </text></navLabel><content src="c2.xhtml"/></navPoint></navPoint><navPoint><navLabel><text>Falta</text></navLabel><content src="c9.xhtml"/></navPoint></navMap></ncx>'


def test_pages_are_held_a_few_at_a_time(spark, monkeypatch):
    """A batch of pages is converted by slices, in order, errors and nulls too, and an empty batch gives an empty one."""
    taken, real = [], html.to_markdown
    monkeypatch.setattr(html, "SLICE", 2)
    monkeypatch.setattr(html, "to_markdown", lambda page: taken.append(page) or (1 / 0 if page == "bad" else real(page)))
    got = []
    monkeypatch.setattr(html.F, "arrow_udf", lambda kind: lambda f: got.append(f) or (lambda c: c))
    html.converted(None)
    column = html.pa.array(["<p>a</p>", None, "bad", "<p>ñ</p>", "<h1>e</h1>"])
    assert got[0](column).to_pylist() == [{"markdown": "a", "error": None}, {"markdown": "", "error": None}, {"markdown": None, "error": "division by zero"}, {"markdown": "ñ", "error": None}, {"markdown": "# e", "error": None}]
    assert taken == column.to_pylist() and got[0](column.slice(0, 0)).to_pylist() == []


def test_docx():
    text, media = archives.docx_markdown(zipped(DOCX))
    assert text == "# Uno\n\ntexto **fuerte**\n\n![](media/i.png)\n" and media == {"media/i.png": b"png"}


def test_epub_navigation():
    by_ncx, images = archives.epub_segments(zipped({**CHAPTERS, "O/toc.ncx": NCX}))
    assert by_ncx == [("Primero", "# C1\n\n![](O/img/a.png)"), ("Capítulo 2", "dos")] and images == {"O/img/a.png": b"png"}
    nav = "<nav epub:type='landmarks'><a href='cover.xhtml'>no</a></nav><nav epub:type='toc'><ol><li><a href='c2.xhtml'>Se<b>gundo</b></a></li><li><a href='c1.xhtml#a'>x</a></li></ol></nav>"
    by_nav, _ = archives.epub_segments(zipped({**CHAPTERS, "O/nav.xhtml": nav}))
    assert by_nav == [("Se gundo", "dos")]
    assert len(archives.epub_segments(zipped({**CHAPTERS, "O/nav.xhtml": nav}), fragments=True)[0]) == 2
    plain, _ = archives.epub_segments(zipped(CHAPTERS))
    assert [t for t, _ in plain] == ["Capítulo 1", "Capítulo 2"]


def test_parsed_keeps_going_after_damage(spark):
    docs = spark.createDataFrame([("a", "docx", zipped(DOCX)), ("b", "epub", zipped({**CHAPTERS, "O/toc.ncx": NCX})), ("c", "docx", b"junk"), ("d", "md", b"x")], "doc_id string, format string, content binary")
    rows = archives.parsed(docs).collect()
    assert sorted((r.doc_id, r.kind) for r in rows) == [("a", "asset"), ("a", "text"), ("b", "asset"), ("b", "segment"), ("b", "segment"), ("c", "error")]


def test_reading_ends_in_time(spark):
    slow = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n<< /Type /Page /Contents %d 0 R >>\nendobj\n" % (k, k) for k in range(1, 20_000))
    docs = spark.createDataFrame([("slow", slow, None), ("fine", None, XML)], "doc_id string, content binary, xml string").coalesce(1)
    found = pdf.items(docs, seconds=0.02)
    assert [(r.doc_id, r.error) for r in found.filter("kind = 'error'").collect()] == [("slow", "TimeoutError: over 0.02 s")] and pdf.runs(found).filter("doc_id = 'fine'").count() == 2
    with pytest.raises(TimeoutError), limited(0.01):
        time.sleep(1)
    with limited(5):
        pass


def test_uploads(spark, tmp_path):
    (tmp_path / "u" / "v").mkdir(parents=True)
    for name in ("a.md", "v/b.HTM", "c.exe", "d"):
        (tmp_path / "u" / name).write_text("hola")
    rows = files.uploads(spark, str(tmp_path / "u")).collect()
    assert sorted((r.name, r.format, r.length) for r in rows) == [("a.md", "md", 4), ("b.HTM", "html", 4)]
    assert files.listing(spark, str(tmp_path / "u"), "/v/").count() == 1
    (tmp_path / "u" / "x" / "v").mkdir(parents=True)
    (tmp_path / "u" / "x" / "v" / "e.md").write_text("no")
    assert [r.key for r in files.listing(spark, f"file://{tmp_path}/u", "v/").collect()] == ["v/b.HTM"]
    assert [(r.name, bytes(r.content)) for r in files.upload(spark, str(tmp_path / "u"), "x/v/e.md").collect()] == [("e.md", b"no")]


def pdf_file(pages):
    objects, kids = [], []
    for lines in pages:
        body = b"BT " + b" ".join(b"/F1 %d Tf 1 0 0 1 %d %d Tm (%s) Tj" % (size, x, y, text.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)")) for size, x, y, text in lines) + b" ET"
        objects.append(b"<< /Type /Page /MediaBox [0 0 600 800] /Contents %d 0 R >>" % (len(objects) + 2))
        kids.append(len(objects))
        packed = zlib.compress(body)
        objects.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream")
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj" for i, o in enumerate(objects)) + b"\n%%EOF"


XML = '<pdf2xml><page number="1" width="600" height="800"><fontspec id="0" size="20"/><fontspec id="1" size="11"/><text top="10" left="5" width="50" font="0">Gran <b>Título</b></text><text top="40" left="5" width="50" font="1">cuerpo</text><image top="60" left="0" width="100" height="90" src="i.png"/></page></pdf2xml>'


def test_pdf_items(spark):
    docs = spark.createDataFrame([("x", None, XML), ("p", pdf_file([[(20, 50, 700, "Uno (1)"), (11, 50, 660, "años")], [(11, 50, 700, "dos")]]), None), ("bad", b"junk", None)], "doc_id string, content binary, xml string")
    found = pdf.items(docs)
    rows = {(r.doc_id, r.page, r.text): (r.top, r.size) for r in pdf.runs(found).collect()}
    assert rows == {("x", 1, "Gran Título"): (10.0, 20.0), ("x", 1, "cuerpo"): (40.0, 11.0), ("p", 1, "Uno (1)"): (100.0, 20.0), ("p", 1, "años"): (140.0, 11.0), ("p", 2, "dos"): (100.0, 11.0)}
    assert [r.src for r in pdf.images(found).collect()] == ["i.png"] and [r.doc_id for r in found.filter("kind = 'error'").collect()] == ["bad"]


def test_pdf_outline_and_tools(spark):
    outline = '{"bookmarks": [{"title": "A", "page": 1, "kids": [{"title": "A1", "page": 2}, {"title": " ", "page": 2}]}, {"title": "B", "page": 3}]}'
    rows = pdf.bookmarks(spark.createDataFrame([("d", outline), ("e", "junk")], "doc_id string, outline string")).orderBy("ord").collect()
    assert [(r.ord, r.depth, r.title, r.page) for r in rows] == [(0, 1, "A", 1), (1, 2, "A1", 2), (2, 1, "B", 3)]
    counts = spark.createDataFrame([("Title: x\nPages:   12\n",), ("Pages: 0",), ("none",)], "t string").select(pdf.page_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in counts] == [12, None, None]
    assert pdf.raster_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (40).to_bytes(4, "big") + (30).to_bytes(4, "big")) == (40, 30) and pdf.raster_size(b"GIF89a\x05\0\x06\0") == (5, 6) and pdf.raster_size(b"") is None


def full_pdf():
    """A file with a page tree, an outline, an object stream, a composite font, and pictures of three kinds."""

    def packed(head, data):
        return b"<< %s /Filter /FlateDecode /Length 1 >>\nstream\n%s\nendstream" % (head, zlib.compress(data))

    cmap = b"beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0004> <0062> <0005> <0006> [<00F1> <00660069>] endbfrange"
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x40\x00\x50\x03" + b"x" * 20
    raster = b"<< /Type /XObject /Subtype /Image /Width 40 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceRGB"
    inside = {20: b"<< /Title (Cap\xedtulo uno) /Dest [4 0 R /Fit] /First 21 0 R /Next 22 0 R >>", 21: b"<< /Title <FEFF0041> /A << /S /GoTo /D /fin >> >>", 22: b"<< /Title (Nada) /Dest /falta >>"}
    places, body = [], b""
    for k, x in inside.items():
        places.append(b"%d %d" % (k, len(body)))
        body += x + b" "
    head = b" ".join(places) + b" "
    first = b"q 100 0 0 80 50 600 cm /Im1 Do Q BT /F1 11 Tf 1 0 0 1 50 500 Tm <000100020003> Tj ET q 90 0 0 90 50 300 cm /Im2 Do Q"
    second = b"q 2 0 0 2 10 0 cm BT /F2 10 Tf 20 300 Td (dos) Tj 0 -10 TD (tres) Tj ET Q q 99 0 0 70 50 100 cm /Im3 Do Q BT /F1 9 Tf <000500060009> Tj ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R /Dests << /fin [5 0 R /Fit] >> >>", 2: b"<< /Type /Pages /Kids [9 0 R 5 0 R] /MediaBox [0 0 600 800] /Resources 6 0 R >>",
        9: b"<< /Type /Pages /Kids [4 0 R] >>", 3: b"<< /Type /Outlines /First 20 0 R >>", 5: b"<< /Type /Page /Contents [8 0 R] >>", 4: b"<< /Type /Page /Contents 7 0 R >>",
        6: b"<< /Font << /F1 10 0 R /F2 11 0 R >> /XObject << /Im1 12 0 R /Im2 13 0 R /Im3 14 0 R >> >>", 7: packed(b"", first), 8: packed(b"", second),
        10: b"<< /Type /Font /Subtype /Type0 /ToUnicode 15 0 R >>", 11: b"<< /Type /Font /Subtype /Type1 >>", 15: packed(b"", cmap),
        12: b"<< /Subtype /Image /Filter /DCTDecode >>\nstream\n" + jpeg + b"\nendstream", 13: packed(raster[3:], bytes(range(240))), 14: b"<< /Subtype /Image /Filter /JPXDecode >>\nstream\nx\nendstream",
        30: packed(b"/Type /ObjStm /N 3 /First %d" % len(head), head + body),
    }
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % x for x in objects.items()) + b"\n%%EOF", jpeg


def test_plain_pdf_files(spark):
    data, jpeg = full_pdf()
    found = pdf.items(spark.createDataFrame([("p", data, None)], "doc_id string, content binary, xml string"))
    assert [(r.page, r.top, r.left, r.text) for r in pdf.runs(found).orderBy("page", "ord").collect()] == [(1, 300.0, 50.0, "Abc"), (2, 200.0, 50.0, "dos"), (2, 220.0, 50.0, "tres"), (2, 800.0, 0.0, "ñfi")]
    assert [(r.page, r.top, r.left, r.width, r.height, r.src) for r in pdf.images(found).orderBy("page", "ord").collect()] == [(1, 120.0, 50.0, 100.0, 80.0, "image-12.jpg"), (1, 410.0, 50.0, 90.0, 90.0, "image-13.png")]
    assert [(r.depth, r.title, r.page) for r in pdf.own_bookmarks(found).orderBy("ord").collect()] == [(1, "Capítulo uno", 1), (2, "A", 2)]
    files_ = {r.src: bytes(r.content) for r in pdf.pictures(found).collect()}
    assert files_["image-12.jpg"] == jpeg and pdf.raster_size(files_["image-13.png"]) == (40, 2) and set(files_) == {"image-12.jpg", "image-13.png"}
    parts = convert.convert(spark.createDataFrame([("p", "pdf", data)], "doc_id string, format string, content binary"))
    bodies = {r.title: r.body for r in parts.segments.collect()}
    assert list(bodies) == ["Capítulo uno", "A"] and "![imagen](../assets/image-13.png)" in bodies["Capítulo uno"] and "tres" in bodies["A"]
    # the first line of page 1, a picture, is where the bookmark begins
    assert {r.src for r in parts.assets.collect()} == {"image-13.png"}


RUN = "doc_id string, page int, ord int, top double, left double, width double, size double, text string"
PICTURE = "doc_id string, page int, ord int, page_w double, page_h double, top double, left double, width double, height double, src string"


def test_lines_and_images(spark):
    runs = spark.createDataFrame([("d", 1, 0, 10.0, 5.0, 30.0, 11.0, "uno"), ("d", 1, 1, 10.6, 50.0, 30.0, 12.0, "dos"), ("d", 1, 2, 11.2, 90.0, 9.0, 11.0, "tres"), ("d", 1, 3, 90.0, 5.0, 9.0, 11.0, " ")], RUN)
    images = spark.createDataFrame([("d", 1, k, 800.0, 600.0, 11.0, 0.0, w, h, s) for k, (w, h, s) in enumerate([(100.0, 80.0, "i.png"), (10.0, 10.0, "t.png"), (799.0, 599.0, "bg.png"), (100.0, 80.0, "")])], PICTURE)
    rows = sorted(pdf_model.visual_lines(runs, images).collect(), key=lambda r: r.idx)
    assert [(r.text, r.img_src) for r in rows] == [("uno dos", ""), ("", "i.png"), ("tres", "")]
    assert rows[0].size == 12.0 and rows[0].cells == ["uno", "dos"] and rows[0].cols == [5.0, 50.0]
    many = spark.createDataFrame([("d", 1, k, 800.0, 600.0, 1.0, 0.0, 100.0, 80.0, f"{k}.png") for k in range(250)], PICTURE)
    assert pdf_model.accepted_images(many).count() == 200


def lines(spark, rows):
    return spark.createDataFrame([("d", i, page, float(i * 20), 5.0, size, text, cols, cells, img) for i, (page, size, text, cols, cells, img) in enumerate(rows)], pdf_model.LINES)


def row(text, size=11.0, page=1, cells=None, img=""):
    cells = cells or [text]
    return (page, size, text, [5.0 + 100 * k for k in range(len(cells))], cells, img)


def test_segments_by_size(spark):
    found = lines(spark, [row("portada"), row("1. Primera parte", 13.0), row("pala-"), row("bra"), row("a b", cells=["a", "b"]), row("c d", cells=["c", "d"]), row("Gran", 20.0), row("", img="i.png"), row("fin"), row("Vacía", 20.0)])
    rows = sorted(pdf_model.segments_by_size(found).collect(), key=lambda r: r.ord)
    assert [(r.title, r.content) for r in rows] == [("Introducción", "portada"), ("1. Primera parte", "palabra\n| a | b |\n| --- | --- |\n| c | d |"), ("Gran", "![imagen](i.png)\n\nfin")]


def test_titles_are_whole_where_asked_for(spark):
    """Lines of 103 and 132 bytes: the first one's title is cut by default, the second is no heading then."""
    found = lines(spark, [row("x"), row("1. " + "a" * 100, 20.0), row("y"), row("2. " + "b" * 129, 20.0), row("z")])
    titles = lambda whole: [r.title for r in pdf_model.segments_by_size(found, whole).orderBy("ord").collect()]
    assert titles(False) == ["Introducción", "1. " + "a" * 97]
    assert titles(True) == ["Introducción", "1. " + "a" * 100, "2. " + "b" * 129]


def test_cascade(spark):
    found = lines(spark, [row("x"), row("Uno"), row("a"), row("Dos", page=2), row("b", page=2), row("c", page=12)])
    marks = spark.createDataFrame([("d", 0, 1, "UNO", 1), ("d", 1, 1, "uno", 1), ("d", 2, 2, "Dos", 2), ("d", 3, 1, "Lejos", 40)], "doc_id string, ord int, depth int, title string, page int")
    rows = sorted(pdf_model.segments(found, marks).collect(), key=lambda r: r.ord)
    # the bookmark of a page that isn't there begins after the one before, which is left without lines
    assert [(r.title, r.content) for r in rows] == [("Introducción", "x"), ("UNO", "a"), ("Lejos", "c")]
    rows = sorted(pdf_model.segments(found, marks.limit(0)).collect(), key=lambda r: r.ord)
    assert [(r.ord, r.title, r.content) for r in rows] == [(1, "Páginas 1–10", "x\nUno\na\nDos\nb"), (2, "Páginas 11–12", "c")]


def test_all_starts_are_clamped(spark):
    found = lines(spark, [row("", img="i.png"), row("", img="j.png")])
    marks = spark.createDataFrame([("d", k, 1, f"t{k}", 9) for k in range(5)], "doc_id string, ord int, depth int, title string, page int")
    assert [(r.idx, r.title) for r in pdf_model.bookmark_starts(found, marks).orderBy("idx").collect()] == [(0, "t0"), (1, "t1")]


def test_lines_and_tables_stay_in_the_jvm(spark):
    """Pages and tables are folded as arrays: neither a Python task nor more than one exchange by document."""
    runs = spark.createDataFrame([(f"d{k % 3}", 1 + k // 40, k, float(k // 3 * 12) + k % 2 * 0.4, float(k % 3 * 90), 10.0, 11.0, f"t{k}") for k in range(200)], "doc_id string, page int, ord int, top double, left double, width double, size double, text string")
    found = pdf_model.table_blocks(pdf_model.visual_lines(runs), ["doc_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and plan.count("Exchange ") <= 2


def test_sections_are_dealt_by_document_once(spark):
    """Lines are made once, and their sections, tables and contents stay where a document's lines lie."""
    runs = spark.createDataFrame([(f"d{k % 3}", 1 + k // 40, k, float(k // 3 * 12), float(k % 3 * 90), 10.0, 11.0, f"t{k}") for k in range(200)], RUN)
    marks = spark.createDataFrame([("d0", 0, 1, "t0", 1)], "doc_id string, ord int, depth int, title string, page int")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = pdf_model.visual_lines(runs)
    assert plan(pdf_model.segments_by_pages(found)).count("Exchange ") <= 1
    marked = plan(pdf_model.segments_by_bookmarks(found, marks))
    assert "Join" not in marked.split("Union")[0] and "aggregate(items" not in marked


def test_a_start_without_a_line_of_its_own_cuts_nothing(spark):
    found = lines(spark, [row("a", cells=["a", "b"]), row("c", cells=["c", "d"]), row("Uno", cells=["Uno", "x"]), row("e", cells=["e", "f"]), row("g", cells=["g", "h"])])
    starts = spark.createDataFrame([("d", 2, "Uno"), ("d", 9, "Nada"), ("other", 0, "Otro")], "doc_id string, idx int, title string")
    rows = [(r.ord, r.title, r.content) for r in pdf_model.cut_at(found, starts).orderBy("ord").collect()]
    assert rows == [(1, "Introducción", "| a | b |\n| --- | --- |\n| c | d |"), (2, "Uno", "| e | f |\n| --- | --- |\n| g | h |")]


def test_lines_are_anchored_at_their_first_run(spark):
    """Tops of 0, 0.6 and 1.2 are two lines, as the third run is too far from the first; an image ends a line."""
    runs = spark.createDataFrame([("d", 1, 0, 0.0, 5.0, 10.0, 11.0, "a"), ("d", 1, 1, 0.6, 20.0, 10.0, 12.0, "b"), ("d", 1, 2, 1.2, 1.0, 5.0, 9.0, "c"), ("d", 1, 3, 1.3, 99.0, 5.0, 9.0, "d"), ("d", 2, 4, 0.0, 1.0, 5.0, 9.0, "e")], "doc_id string, page int, ord int, top double, left double, width double, size double, text string")
    images = spark.createDataFrame([("d", 1, 0, 1.25, 50.0, 200.0, 100.0, 900.0, 900.0, "i.png")], "doc_id string, page int, ord int, top double, left double, width double, height double, page_w double, page_h double, src string")
    rows = sorted(pdf_model.visual_lines(runs, images).collect(), key=lambda r: r.idx)
    assert [(r.idx, r.page, r.text, list(r.cells), r.img_src) for r in rows] == [(0, 1, "a  b", ["a", "b"], ""), (1, 1, "c", ["c"], ""), (2, 1, "", [], "i.png"), (3, 1, "d", ["d"], ""), (4, 2, "e", ["e"], "")]
    assert (rows[0].top, rows[0].left, rows[0].size, list(rows[0].cols)) == (0.6, 5.0, 12.0, [5.0, 20.0])


def test_tables_are_anchored_at_their_first_line(spark):
    """First cells at 5, 8 and 11: the third is within reach of the second, not of the first, and begins anew."""
    found = [(f"{k}", x, cells) for k, (x, cells) in enumerate([(5.0, 2), (8.0, 2), (11.0, 2), (12.0, 3), (0.0, 1), (12.0, 2), (40.0, 2)])]
    rows = spark.createDataFrame([("d", int(k), 1, float(k), x, 11.0, "t", [x + 50 * c for c in range(n)], ["c"] * n, "") for k, x, n in found], pdf_model.LINES)
    blocks = {r.idx: r.block for r in pdf_model.table_blocks(rows, ["doc_id"]).collect()}
    assert blocks == {0: 0, 1: 0, 2: 2, 3: 2, 4: None, 5: None, 6: None}
