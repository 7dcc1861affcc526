"""Cuts Markdown into segments at its headings of level one and two.

Where headings begin is told by a fold over a text's lines (functions/blocks.py); all else are Column functions. Nothing is
exploded or shuffled, so a document stays one row until its segments are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.blocks import heading_lines
from bindery.functions.text import let, trim_space

#: What every text with a heading holds; the lines of others needn't be read.
CANDIDATE = r"#|(?m)^[ \t>]*+(?:=+|-+)[ \t\r]*$"

#: The titles of a text without headings and of a heading without text.
WHOLE, UNTITLED = "Documento completo", "Sección %d"


def plain_title(heading: Column) -> Column:
    """The text of a heading, without link targets and emphasis."""
    return trim_space(F.regexp_replace(F.regexp_replace(heading, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[*`]+|(?<!\w)_+|_+(?!\w)", ""))


def written(title: Column, content: Column) -> Column:
    """A segment's file: its content, under its title unless it begins with '#' itself."""
    bare = trim_space(content)
    return F.when(bare.startswith("#"), F.concat(bare, F.lit("\n"))).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), content, F.lit("\n")))


def segment_array(text: Column) -> Column:
    """array<struct<ord, title, body>>: the segments of a Markdown text; bodies are ready to be written.

    Text before the first heading belongs to the first segment. A body that doesn't begin with '#' gets its title as one.
    """
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    found = F.struct(F.split(text, "\n", -1).alias("lines"), heading_lines(F.when(text.rlike(CANDIDATE), text)).alias("heads"))

    def one(lines: Column, heads: Column, head: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(head["line"])
        after = F.coalesce(F.get(heads, i + 1)["line"], F.size(lines))
        clean = plain_title(head["title"])
        title = F.when(clean == "", F.format_string(UNTITLED, i + 1)).otherwise(clean)
        content = trim_space(F.array_join(F.slice(lines, start + 1, after - start), "\n"))
        return let(F.struct(title.alias("t"), content.alias("c")), lambda s: F.struct((i + 1).cast("int").alias("ord"), s["t"].alias("title"), written(s["t"], s["c"]).alias("body")))

    whole = F.array(F.struct(F.lit(1).alias("ord"), F.lit(WHOLE).alias("title"), F.concat(F.lit(f"# {WHOLE}\n\n"), trim_space(text), F.lit("\n")).alias("body")))
    cut = lambda f: F.transform(f["heads"], lambda head, i: one(f["lines"], f["heads"], head, i))
    return let(found, lambda f: F.when(F.coalesce(F.size(f["heads"]), F.lit(0)) > 0, cut(f)).otherwise(whole))


def segments(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ord, title, body: a row per segment."""
    return docs.select(key, F.inline(segment_array(F.col(text))))


def segment_file(ord_: Column) -> Column:
    return F.format_string("fragmento-%02d.md", ord_)
