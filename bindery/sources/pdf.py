"""PDF documents: from extracted XML (pages of positioned texts and images) or, for plain files, from their own streams."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.guard import inflated, limited
from bindery.schema import DOCUMENT_SECONDS

ITEMS = "doc_id string, kind string, page int, ord int, top double, left double, width double, height double, size double, text string, page_w double, page_h double, error string, content binary"
BOOKMARK_JSON = "bookmarks array<struct<title:string,page:int,kids:array<struct<title:string,page:int,kids:array<struct<title:string,page:int,kids:array<struct<title:string,page:int>>>>>>>>"


def number(text: str | None) -> float:
    try:
        return float(text or 0)
    except ValueError:
        return 0.0


def xml_items(xml: str) -> Iterator[tuple]:
    """kind, page, ord, top, left, width, height, size, text, page_w, page_h of each text and image of the XML.

    Fonts hold for the whole document, the last of an id; a text is all text below its element.
    """
    root = ElementTree.fromstring(xml)
    sizes = {f.get("id", ""): number(f.get("size")) for f in root.iter("fontspec")}
    seen = 0
    for page in root.iter("page"):
        n = int(number(page.get("number"))) or seen + 1
        w, h = number(page.get("width")), number(page.get("height"))
        for k, e in enumerate(page):
            at = [number(e.get(c)) for c in ("top", "left", "width", "height")]
            if e.tag == "text" and (text := "".join(e.itertext()).strip()):
                seen += 1
                yield ("text", n, k, *at, sizes.get(e.get("font", ""), 0.0), text, w, h)
            elif e.tag == "image":
                seen += 1
                yield ("image", n, k, *at, 0.0, e.get("src", ""), w, h)


STRING = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)|([^\\]+)", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
OPERATOR = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)


class Font(NamedTuple):
    """width: bytes of a code; texts: what codes stand for, empty where the font doesn't say."""

    width: int
    texts: dict[int, str]


class Picture(NamedTuple):
    src: str
    content: bytes


Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o


def string_bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return b"".join(m[2] or ESCAPES.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else m[1]) for m in STRING.finditer(token[1:-1]))


def literal(token: bytes, font: Font | None = None) -> str:
    raw = string_bytes(token)
    if font is not None and (font.texts or font.width > 1):
        codes = [int.from_bytes(raw[i : i + font.width], "big") for i in range(0, len(raw), font.width)]
        return "".join(font.texts.get(c, bytes([c]).decode("cp1252", "replace") if font.width == 1 else "") for c in codes)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def shown(stream: bytes, height: float, fonts: dict[bytes, Font], pictures: dict[bytes, Picture]) -> Iterator[tuple]:
    """kind, top, left, width, height, size, text of what a content stream shows, in its order: the strings, and the pictures
    by their src. Matrices are followed but for turns; a text's width is a guess from its length.
    """
    stack: list[bytes] = []
    size, leading, font = 0.0, 0.0, None
    page, line, at, saved = UNIT, UNIT, UNIT, []
    for token in OPERATOR.findall(re.sub(rb"(?s)\bBI\b.*?\bEI\b", b"", stream)):
        if not re.fullmatch(rb"[A-Za-z'\"*]+", token):
            stack.append(token)
            continue
        n = [number(t.decode("latin-1")) for t in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", t)]
        names = [t[1:] for t in stack if t[:1] == b"/"]
        if token == b"q":
            saved.append(page)
        elif token == b"Q" and saved:
            page = saved.pop()
        elif token == b"cm" and len(n) >= 6:
            page = times(tuple(n[-6:]), page)
        elif token == b"Do" and names and names[-1] in pictures:
            a, _, _, d, e, f = page
            yield "image", height - max(f, f + d), min(e, e + a), abs(a), abs(d), 0.0, pictures[names[-1]].src
        elif token == b"BT":
            line = at = UNIT
        elif token == b"Tf" and n:
            size, font = n[-1], fonts.get(names[-1]) if names else None
        elif token == b"TL" and n:
            leading = n[-1]
        elif token in (b"Td", b"TD") and len(n) >= 2:
            line = at = times((1.0, 0.0, 0.0, 1.0, n[-2], n[-1]), line)
            leading = -n[-1] if token == b"TD" else leading
        elif token == b"Tm" and len(n) >= 6:
            line = at = tuple(n[-6:])
        elif token in (b"T*", b"'", b'"'):
            line = at = times((1.0, 0.0, 0.0, 1.0, 0.0, -leading), line)
        if token in (b"Tj", b"'", b'"', b"TJ"):
            text = "".join(literal(t, font) for t in stack if t[:1] in b"(<")
            _, _, _, d, x, y = times(at, page)
            own = size * (abs(d) or 1.0)
            if text.strip():
                yield "text", height - y, x, 0.5 * own * len(text), own, own, text.strip()
                at = times((1.0, 0.0, 0.0, 1.0, 0.5 * size * len(text), 0.0), at)
        stack.clear()


def stream_of(body: bytes) -> bytes:
    m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
    if m is None:
        return b""
    if b"FlateDecode" in body[: m.start()]:
        return inflated(m[1])
    return m[1]


def objects(data: bytes) -> dict[int, bytes]:
    """The bodies of a file's objects, of those within object streams too."""
    found = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data)}
    for body in [b for b in found.values() if re.search(rb"/Type\s*/ObjStm\b", b)]:
        raw, first = stream_of(body), int(re.search(rb"/First\s+(\d+)", body)[1])
        head = [int(x) for x in raw[:first].split()]
        places = [*head[1::2], len(raw) - first]
        for number_, start, end in zip(head[::2], places, places[1:], strict=False):
            found.setdefault(number_, raw[first + start : first + end])
    return found


def value(found: dict[int, bytes], body: bytes, key: bytes) -> bytes:
    """What an object's dictionary has under key, references followed; nothing if there is no such key."""
    m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", body)
    if m is None:
        return b""
    rest = body[m.end() :]
    if ref := re.match(rb"(\d+)\s+\d+\s+R\b", rest):
        return found.get(int(ref[1]), b"")
    if rest[:2] == b"<<":
        depth = 0
        for mark in re.finditer(rb"<<|>>", rest):
            depth += 1 if mark[0] == b"<<" else -1
            if depth == 0:
                return rest[: mark.end()]
    plain = re.match(rb"(?s)\[[^\]]*\]|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|/?[^\s/<>\[\]()]+", rest)
    return plain[0] if plain else b""


def refs(array: bytes) -> list[int]:
    return [int(i) for i in re.findall(rb"(\d+)\s+\d+\s+R\b", array)]


def page_objects(found: dict[int, bytes]) -> list[tuple[int, bytes]]:
    """number, body of each page in the order of the page tree, with what it inherits after its own entries; without a tree
    in the order of the objects.
    """
    catalog = next((b for b in found.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    out, seen = [], set()
    root = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", catalog)
    waiting = [(int(root[1]), b"")] if root else []
    while waiting:
        i, above = waiting.pop()
        if i in seen or i not in found:
            continue
        seen.add(i)
        body = found[i] + above
        if kids := refs(value(found, found[i], b"Kids")):
            waiting += [(k, b" ".join(b"/%s %s" % (key, got) for key in (b"Resources", b"MediaBox") if (got := value(found, body, key)))) for k in kids[::-1]]
        else:
            out.append((i, body))
    return out or [(i, b) for i, b in sorted(found.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]


def code_map(cmap: bytes) -> dict[int, str]:
    """What a font's codes stand for, from its ToUnicode map."""
    out: dict[int, str] = {}
    text = lambda h: string_bytes(h).decode("utf-16-be", "replace")
    code = lambda h: int.from_bytes(string_bytes(h), "big")
    hexes = rb"<[0-9A-Fa-f\s]*>"
    for block in re.findall(rb"(?s)beginbfchar(.*?)endbfchar", cmap):
        out |= {code(a): text(b) for a, b in re.findall(rb"(%b)\s*(%b)" % (hexes, hexes), block)}
    for block in re.findall(rb"(?s)beginbfrange(.*?)endbfrange", cmap):
        for a, b, to in re.findall(rb"(?s)(%b)\s*(%b)\s*(%b|\[.*?\])" % (hexes, hexes, hexes), block):
            each = re.findall(hexes, to)
            for k in range(min(code(b) - code(a) + 1, 1 << 16)):
                if to[:1] == b"[":
                    out |= {code(a) + k: text(each[k])} if k < len(each) else {}
                elif last := text(to)[-1:]:
                    out[code(a) + k] = text(to)[:-1] + chr(min(ord(last) + k, 0x10FFFF))
    return out


def named(found: dict[int, bytes], resources: bytes, key: bytes) -> dict[bytes, int]:
    """The objects that a page's resources name under key."""
    return {name: int(i) for name, i in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R\b", value(found, resources, key))}


def font_of(found: dict[int, bytes], body: bytes) -> Font:
    texts = code_map(stream_of(value(found, body, b"ToUnicode")))
    return Font(2 if re.search(rb"/Type0\b", body) else 1, texts)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def picture_of(number_: int, body: bytes) -> Picture | None:
    """An image object as a file: JPEG as it is, plain grey and colour rasters of 8 bits as PNG; others give nothing."""
    m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream\s*\Z", body)
    if m is None or not re.search(rb"/Subtype\s*/Image\b", body):
        return None
    head, raw = body[: m.start()], m[1]
    if b"DCTDecode" in head and b"FlateDecode" not in head:
        return Picture(f"image-{number_}.jpg", raw) if raster_size(raw) else None
    channels = 3 if b"/DeviceRGB" in head else 1 if b"/DeviceGray" in head else 0
    if b"FlateDecode" not in head or not channels or (bits := re.search(rb"/BitsPerComponent\s+(\d+)", head)) is None or bits[1] != b"8":
        return None
    w, h = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"Width", b"Height"))
    data = inflated(raw)
    if not re.search(rb"/Predictor\s+1[0-5]\b", head):
        data = b"".join(b"\0" + data[i : i + w * channels] for i in range(0, w * h * channels, w * channels))
    if len(data) < h * (w * channels + 1):
        return None
    header = struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return Picture(f"image-{number_}.png", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b""))


def outline(found: dict[int, bytes], pages: dict[int, int]) -> Iterator[tuple[int, int, str]]:
    """depth, page, title of a file's bookmarks, parents before children; those that lead to no page are left out."""
    catalog = next((b for b in found.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    places = value(found, catalog, b"Dests")
    waiting, seen = [(1, i) for i in refs(b" ".join(re.findall(rb"/First\s+\d+\s+\d+\s+R", value(found, catalog, b"Outlines"))))][:1], set()
    while waiting:
        depth, i = waiting.pop()
        if i in seen or i not in found:
            continue
        seen.add(i)
        body = found[i]
        target = value(found, body, b"Dest") or value(found, value(found, body, b"A"), b"D")
        if target[:1] == b"/":
            target = value(found, places, re.escape(target[1:]))
        page = next((pages[k] for k in refs(target) if k in pages), None)
        if page is not None:
            yield depth, page, literal(value(found, body, b"Title") or b"()").strip()
        # the last that is added is the next to be read
        for key, at in ((rb"/Next\s+(\d+)\s+\d+\s+R", depth), (rb"/First\s+(\d+)\s+\d+\s+R", depth + 1)):
            if m := re.search(key, body):
                waiting.append((at, int(m[1])))


def file_items(data: bytes) -> Iterator[tuple]:
    """The items of a plain PDF file, as xml_items gives them, and its bookmarks (top: the depth) and pictures (asset, once
    each, with its content). Encrypted files and fonts that don't tell their characters aren't read.
    """
    found = objects(data)
    if not found:
        raise ValueError("no PDF objects")
    pages = page_objects(found)
    fonts: dict[int, Font] = {}
    pictures: dict[int, Picture | None] = {}
    for n, (_, page) in enumerate(pages, 1):
        box = [number(x.decode("latin-1")) for x in value(found, page, b"MediaBox").strip(b"[]").split()]
        w, h = box[2:4] if len(box) >= 4 else (612.0, 792.0)
        parts = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        content = b"\n".join(stream_of(found.get(i, b"")) for i in refs(parts[1])) if parts else b""
        resources = value(found, page, b"Resources")
        own_fonts = {name: fonts.get(i) or fonts.setdefault(i, font_of(found, found.get(i, b""))) for name, i in named(found, resources, b"Font").items()}
        own_pictures = {}
        for name, i in named(found, resources, b"XObject").items():
            if i not in pictures:
                pictures[i] = picture_of(i, found.get(i, b""))
                if pictures[i]:
                    yield ("asset", n, i, 0.0, 0.0, 0.0, 0.0, 0.0, pictures[i].src, w, h, pictures[i].content)
            if pictures[i]:
                own_pictures[name] = pictures[i]
        for k, (kind, top, left, width, height, size, text) in enumerate(shown(content, h, own_fonts, own_pictures)):
            yield (kind, n, k, top, left, width, height, size, text, w, h, None)
    numbers = {i: n for n, (i, _) in enumerate(pages, 1)}
    for k, (depth, page, title) in enumerate(outline(found, numbers)):
        yield ("bookmark", page, k, float(depth), 0.0, 0.0, 0.0, 0.0, title, 0.0, 0.0, None)


def items(docs: DataFrame, seconds: float = DOCUMENT_SECONDS) -> DataFrame:
    """ITEMS of PDF documents: (doc_id, content, xml); xml where an extractor gave one, else the file itself is read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.string(), pa.float64(), pa.float64(), pa.string(), pa.binary()]
        for b in batches:
            for doc_id, content, xml in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    with limited(seconds):
                        rows = [(doc_id, *r[:11], None, r[11]) for r in (((*x, None) for x in xml_items(xml)) if xml else file_items(content or b""))]
                except Exception as e:  # noqa: BLE001  any document may be damaged in any way
                    rows = [(doc_id, "error", *[None] * 10, f"{type(e).__name__}: {e}", None)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [f.split()[0] for f in ITEMS.split(", ")])

    return docs.select("doc_id", "content", "xml").mapInArrow(read, ITEMS)


def runs(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'text'").select("doc_id", "page", "ord", "top", "left", "width", "size", "text")


def images(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'image'").select("doc_id", "page", "ord", "page_w", "page_h", "top", "left", "width", "height", F.col("text").alias("src"))


def own_bookmarks(found: DataFrame) -> DataFrame:
    """doc_id, ord, depth, title, page of the outlines that plain files have themselves."""
    return found.filter("kind = 'bookmark' AND text <> ''").select("doc_id", "ord", F.col("top").cast("int").alias("depth"), F.col("text").alias("title"), "page")


def pictures(found: DataFrame) -> DataFrame:
    """doc_id, ord, src, content of the pictures of plain files."""
    return found.filter("kind = 'asset'").select("doc_id", "ord", F.col("text").alias("src"), "content")


def bookmarks(docs: DataFrame) -> DataFrame:
    """doc_id, ord, depth, title, page of an outline given as JSON (doc_id, outline), parents before children."""
    tree = docs.select("doc_id", F.from_json("outline", BOOKMARK_JSON)["bookmarks"].alias("a"))

    def level(rows: Column, depth: int) -> Column:
        """array<struct<path, depth, title, page>> of a level and all below it."""
        own = F.transform(rows, lambda b, i: F.struct(F.array(i.cast("int")).alias("path"), F.lit(depth).alias("depth"), b["title"].alias("title"), b["page"].alias("page")))
        if depth == 4:
            return own
        below = F.flatten(F.transform(rows, lambda b, i: F.transform(level(F.coalesce(b["kids"], F.array()), depth + 1), lambda c: F.struct(F.concat(F.array(i.cast("int")), c["path"]).alias("path"), c["depth"].alias("depth"), c["title"].alias("title"), c["page"].alias("page")))))
        return F.concat(own, below)

    titled = F.filter(F.array_sort(level(F.coalesce(F.col("a"), F.array()), 1)), lambda b: F.coalesce(F.trim(b["title"]), F.lit("")) != "")
    return tree.select("doc_id", F.posexplode(titled).alias("ord", "b")).select("doc_id", "ord", "b.depth", "b.title", "b.page")


def page_count(info: Column) -> Column:
    """The number of pages that a tool's 'Pages: n' line tells; null if it is no positive number."""
    n = F.regexp_extract(info, r"(?m)^Pages:[ \t]+(\d+)[ \t]*$", 1).try_cast("int")
    return F.when(n > 0, n)


def raster_size(content: bytes | None) -> tuple[int, int] | None:
    """width and height of a PNG, GIF or JPEG from its header, without decoding it."""
    data = content or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None
