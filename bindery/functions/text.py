"""Scalar text operators as Column functions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.schema import FORMAT_ALIASES

SOFT_HYPHEN, ZERO_WIDTH = "­", "​"
# The patterns of references, images, links, numbered headings and emails.
REMOTE = r"(?i)^(?:https?://|data:|//)"
IMAGE = r"!\[([^\]]*)\]\(([^)\t\n\f\r ]+)([^)]*)\)"
LINK_TARGET = r"\]\(([^)]+)\)"
IMAGE_TARGET = r"!\[[^\]]*\]\(([^)\t\n\f\r ]+)"
NUMBERED = r"^\d+(?:\.\d+)*[.)]?[\t\n\f\r ]+[^\t\n\f\r ]"
EMAIL = r"^[^@\t\n\f\r ]+@[^@\t\n\f\r ]+\.[^@\t\n\f\r ]+$"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it, within lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(c: Column) -> Column:
    """Strips all Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def parse_format(extension: Column) -> Column:
    """The document format of a file extension, in any case and with or without its dot; null if there is none."""
    bare = F.regexp_replace(F.lower(extension), r"^\.", "")
    out = F.lit(None).cast("string")
    for alias, kind in FORMAT_ALIASES.items():
        out = F.when(bare == alias, kind).otherwise(out)
    return out


def extension_of(name: Column) -> Column:
    return F.regexp_extract(name, r"\.([^./\\]+)$", 1)


def is_heading_like(line: Column) -> Column:
    """All ASCII letters are capitals, or the first word is a number; never a full sentence of over nine words."""
    sentence = line.endswith(".") & (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) > 8)
    letters = F.regexp_replace(line, "[^A-Za-z]", "")
    capitals = (letters != "") & ~letters.rlike("[a-z]")
    head = F.regexp_replace(F.substring_index(line, " ", 1), r"\.$", "")
    return ~sentence & (capitals | (head.rlike(r"^[0-9.IVXLC]+\z") & line.contains(" ")))


def promote_headings(text: Column) -> Column:
    """Turns isolated, short, heading-like lines of a plain text into level-one headings."""
    split = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)

    def promoted(lines: Column, blanks: Column) -> Column:
        def one(raw: Column, i: Column) -> Column:
            line = trim_space(raw)
            alone = (F.when(i == 0, True).otherwise(F.get(blanks, i - 1))) & F.coalesce(F.get(blanks, i + 1), F.lit(True))
            fits = ~F.get(blanks, i) & alone & ~line.startswith("#") & (F.octet_length(line) <= 80) & is_heading_like(line)
            return F.when(fits, F.concat(F.lit("# "), line)).otherwise(raw)

        return F.array_join(F.transform(lines, one), "\n")

    return let(split, lambda lines: let(F.transform(lines, lambda raw: ~raw.rlike(r"(?U)\S")), lambda blanks: promoted(lines, blanks)))


def normalize_text(c: Column) -> Column:
    """For comparing titles: no soft hyphens, single blanks, lower case."""
    return F.lower(collapse_space(F.replace(c, F.lit(SOFT_HYPHEN), F.lit(""))))


def cut_bytes(c: Column, n: int) -> Column:
    """At most n bytes, ending at a whole character."""

    def longest(head: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.length(head)), lambda k: F.octet_length(F.substring(head, F.lit(1), k)) <= n)
        return F.substring(head, F.lit(1), F.array_max(fits))

    return F.when(F.octet_length(c) <= n, c).otherwise(let(F.substring(c, 1, n), longest))


def clean_title(c: Column) -> Column:
    """A heading's title: no soft hyphens, single blanks, 100 bytes at most."""
    return F.trim(cut_bytes(collapse_space(F.replace(c, F.lit(SOFT_HYPHEN), F.lit(""))), 100))


def clean_line(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(ZERO_WIDTH), F.lit("")), r"[ \t]+\z", "")


def collapse_hyphens(c: Column) -> Column:
    """Joins words that a hyphen divides at a line end, if the next line goes on in lower case."""
    return F.regexp_replace(c, rf"(?:{SOFT_HYPHEN}|(?<!\\)-)[ \t]*\n[ \t]*(?=\p{{Ll}}.)", "")


def sanitize_asset_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9._-]", "-"), r"^-+|-+\z", "")


def is_remote_ref(c: Column) -> Column:
    return c.rlike(REMOTE)


def link_targets(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LINK_TARGET), F.lit(1))


def image_targets(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IMAGE_TARGET), F.lit(1))


def rewrite_images(markdown: Column, names: Column) -> Column:
    """Points image references at ../assets/<name> by the map from reference to name; others stay as they are."""
    parts = F.regexp_extract_all(markdown, F.lit(IMAGE), F.lit(0))
    between = F.split(markdown, IMAGE, -1)

    def rewritten(ref: Column) -> Column:
        src = F.regexp_extract(ref, IMAGE, 2)
        name = F.element_at(names, src)
        to = F.concat(F.lit("!["), F.regexp_extract(ref, IMAGE, 1), F.lit("](../assets/"), name, F.regexp_extract(ref, IMAGE, 3), F.lit(")"))
        return F.when(is_remote_ref(src) | name.isNull() | (name == ""), ref).otherwise(to)

    pieces = F.zip_with(between, F.transform(parts, rewritten), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pieces, "")


def valid_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def valid_password(c: Column) -> Column:
    return F.octet_length(c) >= 8
