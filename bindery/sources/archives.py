"""DOCX and EPUB documents: readers of their ZIP archives, in Arrow batches of one document at a time."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions import guard
from bindery.functions.guard import limited
from bindery.schema import DOCUMENT_SECONDS
from bindery.sources.html import to_markdown

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: The title of a chapter without one, and the names of navigation documents in order.
CHAPTER, NAV_NAMES = "Capítulo %d", ("nav.xhtml", "nav.html", "toc.xhtml", "toc.html")


def members(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return guard.members(z)


def run_text(p: ElementTree.Element, rels: dict[str, str]) -> str:
    out = []
    for r in p.iter():
        if r.tag == WORD + "r":
            text = "".join("\t" if t.tag == WORD + "tab" else "\n" if t.tag == WORD + "br" else (t.text or "") for t in r if t.tag in (WORD + "t", WORD + "tab", WORD + "br"))
            style = r.find(WORD + "rPr")
            for tag, mark in (("b", "**"), ("i", "*")):
                if text.strip() and style is not None and style.find(WORD + tag) is not None:
                    text = f"{mark}{text}{mark}"
            out.append(text)
        elif r.tag == DRAW + "blip" and (target := rels.get(r.get(LINK + "embed", ""))):
            out.append(f"![]({target})")
    return "".join(out).strip()


def docx_markdown(content: bytes) -> tuple[str, dict[str, bytes]]:
    """The Markdown of a DOCX document and its media by the path under which the Markdown names them."""
    files = members(content)
    rels: dict[str, str] = {}
    if (raw := files.get("word/_rels/document.xml.rels")) is not None:
        rels = {e.get("Id", ""): e.get("Target", "") for e in ElementTree.fromstring(raw)}
    body = ElementTree.fromstring(files["word/document.xml"]).find(WORD + "body")
    blocks: list[str] = []
    for e in body if body is not None else ():
        if e.tag == WORD + "tbl":
            rows = [[" ".join(run_text(p, rels) for p in cell.iter(WORD + "p")).strip() for cell in row.iter(WORD + "tc")] for row in e.iter(WORD + "tr")]
            if rows:
                blocks.append("\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])]))
        elif e.tag == WORD + "p" and (text := run_text(e, rels)):
            props = e.find(WORD + "pPr")
            style = props.find(WORD + "pStyle").get(WORD + "val", "") if props is not None and props.find(WORD + "pStyle") is not None else ""
            level = re.fullmatch(r"(?:Heading|Ttulo|Título|heading)\s*([1-6])", style)
            if level or style == "Title":
                blocks.append("#" * (int(level[1]) if level else 1) + " " + text.replace("**", ""))
            elif props is not None and props.find(WORD + "numPr") is not None:
                item = "- " + text
                if blocks and blocks[-1].startswith("- "):
                    blocks[-1] += "\n" + item
                else:
                    blocks.append(item)
            else:
                blocks.append(text)
    media = {k.removeprefix("word/"): v for k, v in files.items() if k.startswith("word/media/")}
    return "\n\n".join(blocks) + "\n", media


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def ncx_entries(files: dict[str, bytes]) -> list[tuple[str, str]]:
    """title, path of each point of the table of contents, parents before children."""
    name = next((f for f in files if posixpath.basename(f).lower() == "toc.ncx"), None)
    if name is None:
        return []
    folder, out = posixpath.dirname(name), []
    for point in ElementTree.fromstring(files[name]).iter():
        if local(point.tag) == "navPoint":
            title = "".join(t.text or "" for c in point if local(c.tag) == "navLabel" for t in c.iter() if local(t.tag) == "text").strip()
            src = next((c.get("src", "") for c in point if local(c.tag) == "content"), "")
            if src:
                out.append((title, posixpath.normpath(posixpath.join(folder, src))))
    return out


def nav_entries(files: dict[str, bytes]) -> list[tuple[str, str]]:
    """title, path of each link of a navigation document."""
    pages = [n for n in NAV_NAMES if n in files] or sorted(n for n in files if n.lower().endswith((".html", ".xhtml")))
    for name in pages:
        text = files[name].decode("utf-8", "replace")
        for nav in re.finditer(r"(?is)<nav\b([^>]*)>(.*?)</nav>", text):
            kind = re.search(r"""epub:type\s*=\s*["']([^"']*)""", nav[1])
            if kind is None or "toc" in kind[1]:
                folder = posixpath.dirname(name)
                found = re.findall(r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>""", nav[2])
                return [(re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", title)).strip(), posixpath.normpath(posixpath.join(folder, href)) if folder and not href.startswith("/") else href) for href, title in found]
    return []


def chapters(files: dict[str, bytes]) -> list[tuple[str, str]]:
    """title, path of all pages by name, where a book has no navigation."""
    names = sorted(n for n in files if n.lower().endswith((".html", ".xhtml")) and not re.search("nav|toc|cover", n.lower()))
    return [(CHAPTER % (k + 1), n) for k, n in enumerate(names)]


def resolve(files: dict[str, bytes], src: str, fragments: bool = False) -> str | None:
    """The archive's path of a reference: itself, else the first by name with the same base name."""
    src = src.split("#")[0] if fragments else src
    return src if src in files else min((n for n in files if posixpath.basename(n) == posixpath.basename(src)), default=None)


def epub_segments(content: bytes, fragments: bool = False) -> tuple[list[tuple[str, str]], dict[str, bytes]]:
    """title, Markdown of each chapter in order, and the images that they show, by path.

    Entries of the navigation that lead to no page are left out; with `fragments`, a '#' part of a reference is ignored.
    """
    files = members(content)
    entries = ncx_entries(files) or nav_entries(files) or chapters(files)
    out, images = [], {}
    for title, src in entries:
        if (name := resolve(files, src, fragments)) is None:
            continue
        folder = posixpath.dirname(name)

        def relink(m: re.Match, folder: str = folder) -> str:
            path = posixpath.normpath(posixpath.join(folder, m[2]))
            if re.match(r"(?i)https?://|data:|//", m[2]) or (found := resolve(files, path)) is None:
                return m[0]
            images[found] = files[found]
            return f"![{m[1]}]({found}{m[3]})"

        text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)([^)]*)\)", relink, to_markdown(files[name].decode("utf-8", "replace")))
        out.append((title or CHAPTER % (len(out) + 1), text))
    if not out:
        raise ValueError("no navigation and no page")
    return out, images


PARSED = "doc_id string, kind string, ord int, title string, body string, path string, content binary, error string"


def parsed(docs: DataFrame, fragments: bool = False, seconds: float = DOCUMENT_SECONDS) -> DataFrame:
    """PARSED rows of DOCX and EPUB documents (doc_id, format, content): kind 'text' (a whole DOCX), 'segment' (an EPUB
    chapter), 'asset', or 'error' where a document can't be read, or not within `seconds`; its error doesn't stop the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, kind, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[tuple] = []
                try:
                    with limited(seconds):
                        if kind == "docx":
                            text, media = docx_markdown(content)
                            rows.append((doc_id, "text", 1, None, text, None, None, None))
                        else:
                            found, media = epub_segments(content, fragments)
                            rows += [(doc_id, "segment", k + 1, t, body, None, None, None) for k, (t, body) in enumerate(found)]
                    rows += [(doc_id, "asset", k + 1, None, None, path, data, None) for k, (path, data) in enumerate(media.items())]
                except Exception as e:  # noqa: BLE001  any document may be damaged in any way
                    rows = [(doc_id, "error", 0, None, None, None, None, f"{type(e).__name__}: {e}")]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [f.split()[0] for f in PARSED.split(", ")])

    return docs.filter(F.col("format").isin("docx", "epub")).select("doc_id", "format", "content").mapInArrow(read, PARSED)
