"""HTML to Markdown with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.functions.guard import limited
from bindery.schema import DOCUMENT_SECONDS

SKIPPED = {"script", "style", "head", "template", "noscript", "iframe"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "figure", "figcaption", "form", "address", "dl", "dt", "dd", "fieldset", "table", "ul", "ol", "blockquote", "pre", "hr"}
MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class MarkdownWriter(HTMLParser):
    """Collects Markdown blocks from a stream of tags; unclosed tags end with the text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.prefix: list[str] = []  # of quotes and list items
        self.lists: list[list] = []
        self.skip = 0
        self.links: list[str] = []
        self.pre = 0
        self.heading = 0
        self.rows: list[list[str]] | None = None
        self.cell = False
        self.pending = ""

    def end_cell(self) -> None:
        """Puts what stands in an open table cell into its row."""
        if self.cell and self.rows is not None:
            text = re.sub(r"\s+", " ", "".join(self.line).replace("\x00", " ")).strip().replace("|", "\\|")
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(text)
        self.line, self.cell = [], False

    def end_block(self) -> None:
        text = "".join(self.line)
        self.line = []
        if self.pre:
            text = text.strip("\n")
        else:
            text = re.sub(r" ?\x00 ?", "  \n", re.sub(r"[ \t\n\f\r]+", " ", text)).strip()
            text = re.sub(r"(\*\*|`)\1|__", "", text).strip()
        if not text:
            return
        lead = "".join(self.prefix)
        first = lead + self.pending
        rest = lead + " " * len(self.pending)
        self.pending = ""
        lines = text.split("\n")
        self.out.append("\n".join([first + lines[0], *(rest + x for x in lines[1:])]))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.end_block()
            self.line.append("#" * int(tag[1]) + " ")
        elif tag == "br":
            self.line.append("\n" if self.pre else "\x00")
        elif tag == "img":
            if a.get("src"):
                title = f' "{a["title"]}"' if a.get("title") else ""
                self.line.append(f"![{a.get('alt') or ''}]({a['src']}{title})")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            if self.links[-1]:
                self.line.append("[")
        elif tag in MARKS and not self.pre:
            self.line.append(MARKS[tag])
        elif tag == "li":
            self.end_block()
            if self.lists:
                self.lists[-1][1] += 1
                kind, n = self.lists[-1]
                self.pending = "  " * (len(self.lists) - 1) + (f"{n}. " if kind == "ol" else "- ")
        elif tag == "tr" and self.rows is not None:
            self.end_cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.end_cell()
            self.cell = True
        elif tag in BLOCKS:
            if self.rows is None:
                self.end_block()
            else:
                self.line.append(" ")
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            elif tag == "blockquote":
                self.prefix.append("> ")
            elif tag == "pre":
                self.pre += 1
                self.out.append("```")
            elif tag == "hr":
                self.out.append("---")
            elif tag == "table":
                self.rows = []

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip or tag in VOID:
            return
        if re.fullmatch("h[1-6]", tag) or tag == "li":
            self.end_block()
        elif tag == "a" and self.links:
            if href := self.links.pop():
                self.line.append(f"]({href})")
        elif tag in MARKS and not self.pre:
            self.line.append(MARKS[tag])
        elif tag in ("td", "th", "tr") and self.rows is not None:
            self.end_cell()
        elif tag in BLOCKS:
            if self.rows is None or tag == "table":
                self.end_block() if self.rows is None else self.end_cell()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "blockquote" and self.prefix:
                self.prefix.pop()
            elif tag == "pre" and self.pre:
                self.pre -= 1
                self.out.append("```")
            elif tag == "table" and self.rows is not None:
                self.end_cell()
                rows, self.rows = [r for r in self.rows if r], None
                if rows:
                    self.out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])]))

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.line.append(data)


def to_markdown(html: str | None) -> str:
    """The Markdown of an HTML text: headings, paragraphs, lists, links, images, emphasis, code, quotes and tables."""
    w = MarkdownWriter()
    w.feed(html or "")
    w.close()
    w.end_block()
    out, fence = [], False
    for block in w.out:
        if block == "```":
            fence = not fence
            out.append(block if fence or not out else out.pop() + "\n```")
        elif fence and out and out[-1].startswith("```"):
            out[-1] += "\n" + block
        else:
            item = re.match(r"(\s*)(- |\d+\. )", block)
            last = re.match(r"(\s*)(- |\d+\. )", out[-1].rsplit("\n", 1)[-1]) if out else None
            if item and last and (item[1] != last[1] or item[2] == last[2] == "- " or "." in item[2] and "." in last[2]):
                out[-1] += "\n" + block
            else:
                out.append(block)
    return "\n\n".join(out)


#: Pages that a task holds as Python's strings at a time.
SLICE = 64


def converted(html: Column, seconds: float = DOCUMENT_SECONDS) -> Column:
    """struct<markdown, error>: a page as Markdown, or why it isn't: a page that takes longer than `seconds` doesn't stop others."""

    kind = pa.struct([("markdown", pa.string()), ("error", pa.string())])

    @F.arrow_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())]))
    def convert(column: pa.Array) -> pa.Array:
        done = [pa.array([], kind)]
        for at in range(0, len(column), SLICE):  # a few pages at a time are Python's strings
            out = []
            for page in column.slice(at, SLICE):
                try:
                    with limited(seconds):
                        out.append({"markdown": to_markdown(page.as_py()), "error": None})
                except Exception as e:  # noqa: BLE001  any document may be damaged in any way
                    out.append({"markdown": None, "error": str(e) or type(e).__name__})
            done.append(pa.array(out, kind))
        found = pa.concat_arrays(done)
        pa.default_memory_pool().release_unused()
        return found

    return convert(html)


def html_to_markdown(html: Column) -> Column:
    """A page as Markdown; null for one that can't be read."""
    return converted(html)["markdown"]


def page_title(html: Column) -> Column:
    """The text of the first h1, without tags."""
    return F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]*>", "")


def page_links(html: Column) -> Column:
    """The href of each anchor, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href="([^"]*)\""""), F.lit(1))
