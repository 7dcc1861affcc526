"""PDF documents after extraction: runs of text and images to lines, headings, sections, tables and segments.

All of it are Column functions: a page's runs, and a table's lines, are sorted arrays that are folded where they lie, and
what needs no order beyond a window is expressed by window functions. Rows are dealt by document once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.frames import settled
from bindery.functions.text import NUMBERED, SOFT_HYPHEN, clean_line, clean_title, collapse_hyphens, collapse_space, normalize_text, trim_space

MIN_SIDE, MAX_COVER, MAX_IMAGES = 32.0, 0.95, 200
SAME_LINE, SAME_COLUMN, MAX_SPACES = 1.0, 4.0, 4
CHUNK_PAGES, TITLE_BYTES = 10, 120
INTRO, IMAGE = "Introducción", "![imagen](%s)\n\n"


def accepted_images(images: DataFrame) -> DataFrame:
    """Images that are neither tiny nor a page's background; the first MAX_IMAGES of a document."""
    fits = (F.coalesce("src", F.lit("")) != "") & (F.col("width") >= MIN_SIDE) & (F.col("height") >= MIN_SIDE)
    background = (F.col("page_w") > 0) & (F.col("page_h") > 0) & (F.col("width") * F.col("height") >= MAX_COVER * F.col("page_w") * F.col("page_h"))
    order = Window.partitionBy("doc_id").orderBy("page", "ord")
    return images.filter(fits & ~F.coalesce(background, F.lit(False))).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MAX_IMAGES).drop("n")


#: What visual_lines() gives.
LINES = "doc_id string, idx int, page int, top double, left double, size double, text string, cols array<double>, cells array<string>, img_src string"


def begins(items: Column, value: Callable[[Column], Column], same: Callable[[Column], Column]) -> Column:
    """array<int>: where groups begin in a sorted array. An item belongs to the group of the one before if the distance of its
    value to that of the group's first item is the same by `same`; items without a value stand alone.
    """
    none = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begin"))

    def step(state: Column, item: Column) -> Column:
        own = value(item)
        joins = F.coalesce(same(F.abs(own - state["first"])), F.lit(False))
        return F.struct(F.when(joins, state["first"]).otherwise(own).alias("first"), (state["at"] + 1).alias("at"), F.when(joins, state["begin"]).otherwise(F.concat(state["begin"], F.array(state["at"]))).alias("begin"))

    return F.aggregate(items, none, step, lambda state: state["begin"])


def groups(items: Column, begin: Column) -> Column:
    """The array's groups, as arrays."""
    return F.transform(begin, lambda b, k: F.slice(items, b + 1, F.coalesce(F.get(begin, k + 1), F.size(items)) - b))


def spaces(gap: Column) -> Column:
    """How many blanks stand for a gap between two runs of a line: one for every three points beyond two, and four at most."""
    n = 1 + F.least(F.greatest((gap - 2) / 3, F.lit(-9.0)), F.lit(9.0)).cast("int")
    return F.when(n.between(1, MAX_SPACES), n).otherwise(1)


def line_of(runs: Column) -> Column:
    """A line's top, left, size, text, cols, cells, img_src from its runs in order."""

    def piece(run: Column, k: Column) -> Column:
        before = F.get(runs, k - 1)
        return F.when(k == 0, run["text"]).otherwise(F.concat(F.repeat(F.lit(" "), spaces(run["left"] - before["left"] - before["width"])), run["text"]))

    first = F.get(runs, F.lit(0))
    image = first["img_src"] != ""
    each = lambda name, empty: F.when(image, F.array().cast(empty)).otherwise(F.transform(runs, lambda r: r[name]))
    return F.struct(
        F.get(runs, F.size(runs) - 1)["top"].alias("top"), F.array_min(F.transform(runs, lambda r: r["left"])).alias("left"), F.array_max(F.transform(runs, lambda r: r["size"])).alias("size"),
        F.array_join(F.transform(runs, piece), "").alias("text"), each("left", "array<double>").alias("cols"), each("text", "array<string>").alias("cells"), first["img_src"].alias("img_src"),
    )


def visual_lines(runs: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id, idx, page, top, left, size, text, cols, cells, img_src: runs whose top is within SAME_LINE of their line's first
    run form a line; images stand alone.
    """
    items = runs.withColumn("text", trim_space(F.coalesce("text", F.lit("")))).filter("text <> ''").select("doc_id", "page", "ord", "top", "left", "width", "size", "text", F.lit("").alias("img_src"))
    if images is not None:
        zero = F.lit(0.0)
        items = items.unionByName(accepted_images(images).select("doc_id", "page", (F.col("ord") + (1 << 30)).alias("ord"), "top", "left", zero.alias("width"), zero.alias("size"), F.lit("").alias("text"), F.col("src").alias("img_src")))
    kinds = {c: F.col(c).cast("double") for c in ("top", "left", "width", "size")}
    items = items.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page").cast("int").alias("page"), "ord", "text", "img_src", *[v.alias(c) for c, v in kinds.items()])
    pages = items.repartition("doc_id").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("top", "left", "ord", "text", "width", "size", "img_src"))).alias("items"))
    begin = begins(F.col("items"), lambda x: F.when(x["img_src"] == "", x["top"]), lambda far: far < SAME_LINE)
    lines = pages.withColumn("begin", begin).select("doc_id", "page", F.transform(groups(F.col("items"), F.col("begin")), line_of).alias("lines"))
    before = F.sum(F.size("lines")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.withColumn("before", F.coalesce(before, F.lit(0))).select("doc_id", "before", "page", F.posexplode("lines").alias("at", "line"))
    return placed.select("doc_id", (F.col("before") + F.col("at")).cast("int").alias("idx"), "page", "line.*")


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the upper median of the sizes above 0."""
    return lines.filter("size > 0").groupBy("doc_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size DESC)").alias("body"))


def headings(lines: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, idx, page, title of lines that are large, or numbered and a little larger than the body. Those of over
    TITLE_BYTES are none, and titles are cut as clean_title() does; if whole, neither holds.
    """
    text = trim_space(F.col("text"))
    big = F.col("size") >= F.greatest(F.col("body") * 1.3, F.col("body") + 6)
    numbered = (F.col("size") >= F.col("body") + 1) & text.rlike(NUMBERED)
    fits = (text != "") & (big | numbered) & ((F.octet_length(text) <= TITLE_BYTES) | F.lit(whole)) & text.rlike(r"\p{L}")
    body = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN size > 0 THEN size END DESC) OVER (PARTITION BY doc_id)")
    title = collapse_space(F.replace(text, F.lit(SOFT_HYPHEN), F.lit(""))) if whole else clean_title(text)
    return lines.withColumn("body", body).filter(fits).select("doc_id", "idx", "page", title.alias("title"))


def sections(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """lines with section (0 before the first start), title, is_start and n_starts; starts: doc_id, idx, title. Documents
    without a start give no line. A start stands before its line, so that one order by document shows both.
    """
    rows = lines.withColumn("title", F.lit(None).cast("string")).withColumn("kind_", F.lit(1))
    rows = rows.unionByName(starts.select("doc_id", "idx", "title", F.lit(0).alias("kind_")), allowMissingColumns=True)
    in_order, by_line = Window.partitionBy("doc_id").orderBy("idx", "kind_"), Window.partitionBy("doc_id").orderBy("idx")
    begins_ = F.lag(F.when(F.col("kind_") == 0, F.struct("idx", "title"))).over(in_order)
    found = rows.withColumn("start_", begins_).filter("kind_ = 1").withColumn("is_start", F.coalesce(F.col("start_.idx") == F.col("idx"), F.lit(False)))
    so_far, whole = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.col("is_start").cast("int")
    out = found.withColumn("section", F.sum(one).over(so_far)).withColumn("title", F.coalesce(F.last(F.when(F.col("is_start"), F.col("start_.title")), True).over(so_far), F.lit(INTRO)))
    return out.withColumn("n_starts", F.sum(one).over(whole)).filter("n_starts > 0").drop("start_", "kind_")


def tabled(lines: DataFrame, group: list[str], able: Column) -> DataFrame:
    """lines with block and last_: as table_blocks() has it, and whether a line is its table's last one. Only lines that are
    able are in tables. What is dealt by document stays so: an island's keys aren't taken apart and put together again.
    """
    columns = lines.columns
    own = [c for c in dict.fromkeys(["doc_id", "page", *group])]
    in_order = Window.partitionBy("doc_id").orderBy("idx")
    marked = lines.withColumn("able_", able)
    same = F.struct(*own, "able_")
    marked = marked.withColumn("cut_", F.coalesce(~F.lag(same).over(in_order).eqNullSafe(same), F.lit(True)).cast("int"))
    marked = marked.withColumn("island_", F.sum("cut_").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = marked.groupBy(*own, "able_", "island_").agg(F.sort_array(F.collect_list(F.struct("idx", *[c for c in columns if c != "idx" and c not in own]))).alias("lines_"))
    begin = begins(F.col("lines_"), lambda x: F.when(F.col("able_"), F.get(x["cols"], F.lit(0))), lambda far: far <= SAME_COLUMN)

    def table(t: Column) -> Column:
        block = F.when(F.size(t) >= 2, F.get(t, F.lit(0))["idx"]).cast("int")
        return F.transform(t, lambda x, k: F.struct(x.alias("line"), block.alias("block"), (k == F.size(t) - 1).alias("last_")))

    rows = F.flatten(F.transform(groups(F.col("lines_"), F.col("begin_")), table))
    placed = parts.withColumn("begin_", begin).select(*own, F.explode(rows).alias("row_"))
    of = [c if c in own else F.col(f"row_.line.{c}") for c in columns]
    return placed.select(*of, "row_.block", "row_.last_")


def table_blocks(lines: DataFrame, group: list[str]) -> DataFrame:
    """lines with block: the idx at which the line's table begins, null outside tables.

    A table: two adjacent lines or more of a page with two cells or more, whose first cell is within SAME_COLUMN of the
    first line's; a table ends with its group. Adjacent lines with cells are an island; an island is folded into tables.
    """
    return tabled(lines, group, F.size("cells") >= 2).drop("last_")


def rendered(lines: DataFrame, group: list[str], hidden: Column | None = None) -> DataFrame:
    """group, content: a section's lines as Markdown, with its images and tables. Hidden lines, which aren't to stand between
    others of their group, give nothing, but for the group's row.
    """
    hidden = F.lit(False) if hidden is None else hidden
    rows = tabled(lines, group, (F.size("cells") >= 2) & ~hidden)
    row = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: trim_space(clean_line(c))), " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("cells")), F.lit("\n"))
    first = F.col("block") == F.col("idx")
    text = clean_line(F.col("text"))
    piece = (
        F.when(hidden, "")
        .when(F.col("img_src") != "", F.format_string(IMAGE, "img_src"))
        .when(F.col("block").isNotNull(), F.concat(row, F.when(first, rule).otherwise(""), F.when(F.col("last_"), "\n").otherwise("")))
        .when(text != "", F.concat(text, F.lit("\n")))
        .otherwise("")
    )
    pieces = F.sort_array(F.collect_list(F.struct("idx", "piece")))
    joined = F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
    return rows.withColumn("piece", piece).groupBy(*group).agg(trim_space(collapse_hyphens(joined)).alias("content"))


def cut_at(lines: DataFrame, starts: DataFrame, keep_empty_intro: bool = False) -> DataFrame:
    """doc_id, ord, title, content of the sections that starts cut; empty ones are left out unless a document has one start.
    Documents without a start give no row.
    """
    all_ = rendered(sections(lines, starts), ["doc_id", "section", "title", "n_starts"], F.col("is_start"))
    kept = all_.filter((F.col("content") != "") | (F.col("section") > 0) & (F.col("n_starts") == 1) | ((F.col("section") == 0) & F.lit(keep_empty_intro)))
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("section")).alias("ord"), "title", "content")


def segments_by_size(lines: DataFrame, whole_titles: bool = False) -> DataFrame:
    """Level 2: cut at the headings that font sizes show. Documents without any give no row."""
    lines = settled(lines)
    return cut_at(lines, headings(lines, whole_titles))


def distinct_bookmarks(bookmarks: DataFrame) -> DataFrame:
    """Bookmarks down to depth 3 with a page; of adjacent ones with the same title the first."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    usable = bookmarks.filter("depth <= 3 AND page >= 1 AND trim(title) <> ''").withColumn("norm", normalize_text(F.col("title")))
    return usable.withColumn("prev", F.lag("norm").over(order)).filter("prev IS NULL OR prev <> norm").drop("prev")


def bookmark_starts(lines: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """doc_id, idx, title: the line of each bookmark, on its page by title, else the page's first line, else line 0.

    Starts are made to increase; those beyond the document's last line are clamped to it, and of equal ones the first stays.
    """
    target, text = F.col("norm"), F.col("own")
    near = text.startswith(target) | (target.startswith(text) & (text != "") & (F.octet_length(target) - F.octet_length(text) < 30))
    marks = distinct_bookmarks(bookmarks)
    at = marks.join(lines.select("doc_id", "page", "idx", normalize_text(F.col("text")).alias("own")), ["doc_id", "page"], "left").groupBy("doc_id", "ord", "title").agg(F.coalesce(F.min(F.when(near, F.col("idx"))), F.min("idx"), F.lit(0)).alias("idx"))
    last = lines.groupBy("doc_id").agg(F.max("idx").alias("last"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    n = F.row_number().over(order)
    # increasing: idx_k = max over j <= k of (idx_j + k - j)
    grown = at.join(last, "doc_id").withColumn("n", n).withColumn("idx", F.max(F.col("idx") - F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("n"))
    clamped = grown.withColumn("idx", F.least("idx", "last"))
    return clamped.groupBy("doc_id", "idx").agg(F.min_by("title", "n").alias("title")).withColumn("title", clean_title(F.col("title")))


def segments_by_bookmarks(lines: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Level 1: cut at the outline's bookmarks. Documents without any give no row."""
    lines = settled(lines)
    return cut_at(lines, bookmark_starts(lines, bookmarks), keep_empty_intro=True)


def page_chunk(page: Column, size: int = CHUNK_PAGES) -> Column:
    return F.floor((page - 1) / size)


def chunk_title(chunk: Column, pages: Column, size: int = CHUNK_PAGES) -> Column:
    first, last = chunk * size + 1, F.least((chunk + 1) * size, pages)
    return F.format_string("Páginas %d–%d", first.cast("long"), last.cast("long"))


def segments_by_pages(lines: DataFrame, size: int = CHUNK_PAGES) -> DataFrame:
    """Level 3: a segment for every `size` pages."""
    whole = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paged = lines.withColumn("section", page_chunk(F.col("page"), size)).withColumn("pages", F.max("page").over(whole))
    chunked = paged.withColumn("title", chunk_title(F.col("section"), F.col("pages"), size)).drop("pages")
    content = rendered(chunked, ["doc_id", "section", "title"])
    return content.select("doc_id", (F.col("section") + 1).cast("int").alias("ord"), "title", "content")


def segments(lines: DataFrame, bookmarks: DataFrame, size: int = CHUNK_PAGES) -> DataFrame:
    """The first level that gives a document segments, of bookmarks, sizes and pages; later ones see only the others."""
    lines = settled(lines)
    one = settled(cut_at(lines, bookmark_starts(lines, bookmarks), keep_empty_intro=True))
    rest = lines.join(one.select("doc_id").distinct(), "doc_id", "left_anti")
    two = settled(cut_at(rest, headings(rest)))
    rest = rest.join(two.select("doc_id").distinct(), "doc_id", "left_anti")
    return one.unionByName(two).unionByName(segments_by_pages(rest, size))
