"""A document's assets: equal contents once, unique names, references rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions.text import image_targets, is_remote_ref, rewrite_images, sanitize_asset_name

#: Different contents of a document.
MAX_ASSETS = 200


def distinct_assets(assets: DataFrame) -> DataFrame:
    """Of (doc_id, ord, src, content) the first of each content within a document, with its sha1."""
    keyed = assets.withColumn("sha1", F.sha1("content"))
    first = Window.partitionBy("doc_id", "sha1").orderBy("ord", "src")
    return keyed.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def capped_assets(assets: DataFrame, most: int = MAX_ASSETS) -> DataFrame:
    """Of (doc_id, ord, src, content) those that come while a document has fewer than `most` different contents, in order of
    ord, then src: a content that is there already takes no place of its own, but after the last one nothing is taken.
    """
    order = Window.partitionBy("doc_id").orderBy("ord", "src")
    new = (F.row_number().over(Window.partitionBy("doc_id", F.sha1("content")).orderBy("ord", "src")) == 1).cast("int")
    before = F.coalesce(F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return assets.withColumn("new_", new).withColumn("before_", before).filter(F.col("before_") < most).select(assets.columns)


def named_assets(assets: DataFrame) -> DataFrame:
    """distinct_assets with name: the sanitised base name, and for all but its first holder the start of the path's sha1."""
    base = F.coalesce(F.nullif(sanitize_asset_name(F.regexp_extract("src", r"([^/]*)/*\z", 1)), F.lit("")), F.lit("asset"))
    order = Window.partitionBy("doc_id", "base").orderBy("ord", "src")
    extension = F.regexp_extract("base", r"(\.[^.]*)\z", 1)
    stem = F.substring(F.col("base"), F.lit(1), F.length("base") - F.length(extension))
    other = F.concat(stem, F.lit("-"), F.substring(F.sha1(F.col("src").cast("binary")), 1, 8), extension)
    return distinct_assets(assets).withColumn("base", base).withColumn("n", F.row_number().over(order)).withColumn("name", F.when(F.col("n") == 1, F.col("base")).otherwise(other)).drop("base", "n")


def asset_names(assets: DataFrame) -> DataFrame:
    """doc_id, src, name for every source path, those of repeated contents too."""
    names = named_assets(assets).select("doc_id", "sha1", "name")
    return assets.select("doc_id", "src", F.sha1("content").alias("sha1")).join(names, ["doc_id", "sha1"]).select("doc_id", "src", "name").distinct()


def relink(segments: DataFrame, assets: DataFrame) -> DataFrame:
    """Segments whose references to the document's own assets lead to their names; unresolved ones stay.

    Only paths within the document's archive resolve: no absolute path, none that leaves by '..'.
    """
    inside = ~F.col("src").rlike(r"^/|(?:^|/)\.\.(?:/|$)")
    names = asset_names(assets.filter(inside))
    # a segment takes the names of what it shows, not those of all its document's assets
    shown = segments.select("doc_id", "ord", F.explode(image_targets(F.col("body"))).alias("src")).distinct()
    own = shown.join(names, ["doc_id", "src"]).groupBy("doc_id", F.col("ord").alias("at_")).agg(F.map_from_entries(F.collect_list(F.struct("src", "name"))).alias("names"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    found = segments.withColumn("at_", F.col("ord")).join(own, ["doc_id", "at_"], "left").select(*[F.col(c) for c in segments.columns], "names")
    return found.withColumn("body", rewrite_images(F.col("body"), F.coalesce("names", empty))).drop("names")


def local_references(segments: DataFrame) -> DataFrame:
    """doc_id, ord, src of each image reference that isn't remote."""
    return segments.select("doc_id", "ord", F.explode(image_targets(F.col("body"))).alias("src")).filter(~is_remote_ref(F.col("src")))
