"""Where the headings of a Markdown text begin: one fold over its lines, in time by their number.

The state is a stack of containers (quotes, list items) and the block that is open in the last of them: a paragraph, a
fence, or an HTML block. A line first has to continue the open containers; what it doesn't continue is closed, but for a
paragraph that goes on lazily. Then it may open containers and a block of its own.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTED = -1
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])( +|$)")
BREAK = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
FENCE = re.compile(r" {0,3}(?:(`{3,})[^`]*|(~{3,}).*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t](.*))?$")
LEAD = re.compile(r"[ \t>*+\-.)\d]*")
CLOSING = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
# What begins an HTML block, and what ends it (None: a blank line). The last one can't interrupt a paragraph.
TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|"
    "iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
)
HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(rf" {{0,3}}</?(?:{TAGS})(?:[ \t]|/?>|$)", re.I), None),
    (re.compile(r" {0,3}<(?:/[A-Za-z][\w-]*[ \t]*|[A-Za-z][\w-]*(?:[ \t]+[A-Za-z_:][\w.:-]*(?:[ \t]*=[ \t]*(?:[^ \t\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*[ \t]*/?)>[ \t]*$"), None),
]


def html_start(rest: str, in_paragraph: bool) -> re.Pattern | str | None:
    """The end of the HTML block that begins here, 'blank' for a blank line; None where none begins."""
    if "<" in rest:
        for begin, end in HTML[:-1] if in_paragraph else HTML:
            if begin.match(rest):
                return end or "blank"
    return None


def begins_block(rest: str) -> bool:
    """Whether the line ends a paragraph that it could continue lazily."""
    return bool(QUOTE.match(rest) or ITEM.match(rest) or BREAK.match(rest) or FENCE.match(rest) or ATX.match(rest) or html_start(rest, True))


def headings(text: str, deepest: int = 2) -> list[tuple[int, str]]:
    """(line, title) of the headings down to that level, anywhere in quotes and lists; an underlined one begins with its
    paragraph.
    """
    found: list[tuple[int, str]] = []
    stack: list[int] = []
    paragraph: list[str] = []
    began, fence, html = 0, "", None
    for n, line in enumerate(text.split("\n")):
        if "\t" in line:
            lead = LEAD.match(line)[0]
            line = lead.expandtabs(4) + line[len(lead) :]
        rest, matched = line, 0
        for kind in stack:
            if kind == QUOTED:
                mark = QUOTE.match(rest)
                if not mark:
                    break
                rest = rest[mark.end() :]
            elif rest[:kind].strip(" ") == "" and (len(rest) >= kind or not rest.strip()):
                rest = rest[kind:]
            else:
                break
            matched += 1
        whole = matched == len(stack)
        if not whole:
            if paragraph and rest.strip() and (rest.startswith("    ") or not begins_block(rest)):
                paragraph.append(rest.strip())
                continue
            del stack[matched:]
            paragraph, fence, html = [], "", None
        if fence:
            bare = rest.strip()
            if bare[:1] == fence[0] and len(bare) >= len(fence) and not bare.strip(fence[0]) and not rest.startswith("    "):
                fence = ""
            continue
        if html is not None:
            if html == "blank" and not rest.strip() or html != "blank" and html.search(rest):
                html = None
            continue
        while not rest.startswith("    "):
            if mark := QUOTE.match(rest):
                stack.append(QUOTED)
                rest = rest[mark.end() :]
            elif (mark := ITEM.match(rest)) and not BREAK.match(rest):
                empty, first = mark.end() == len(rest), mark[2] in "-*+" or int(mark[2][:-1]) == 1
                if paragraph and whole and (empty or not first):
                    break
                width = len(mark[1]) + len(mark[2]) + (1 if empty or len(mark[3]) > 4 else len(mark[3]))
                stack.append(width)
                rest = rest[width:]
            else:
                break
            paragraph, whole = [], False
        bare = rest.strip()
        if not bare:
            paragraph = []
        elif rest.startswith("    "):
            if paragraph:
                paragraph.append(bare)
        elif mark := ATX.match(rest):
            if len(mark[1]) <= deepest:
                found.append((n, CLOSING.sub("", (mark[2] or "").strip())))
            paragraph = []
        elif paragraph and bare[0] in "=-" and not bare.strip(bare[0]):
            if bare[0] == "=" or deepest > 1:
                found.append((began, "\n".join(paragraph)))
            paragraph = []
        elif BREAK.match(rest):
            paragraph = []
        elif mark := FENCE.match(rest):
            fence, paragraph = mark[1] or mark[2], []
        elif (end := html_start(rest, bool(paragraph))) is not None:
            html, paragraph = (None if end != "blank" and end.search(rest) else end), []
        else:
            if not paragraph:
                began = n
            paragraph.append(bare)
    return found


FOUND = pa.list_(pa.struct([("line", pa.int32()), ("title", pa.string())]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("title", T.StringType())])))
def heading_lines(texts: pa.Array) -> pa.Array:
    """The headings of each text; null for null."""
    return pa.array([None if t is None else [{"line": n, "title": title} for n, title in headings(t)] for t in texts.to_pylist()], FOUND)

