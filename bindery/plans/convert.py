"""The main path: documents of six formats to segments and assets, to bundles, to reports, to what is published."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions.frames import settled
from bindery.functions.text import promote_headings
from bindery.operators import assets as assets_
from bindery.operators import bundles, pdf_model, validation
from bindery.operators import jobs as jobs_
from bindery.operators.segments import segments, written
from bindery.sources import archives, html, pdf
from bindery.sources.files import as_text

SEGMENT = ["doc_id", "ord", "title", "body"]


@dataclass
class Converted:
    """segments: doc_id, ord, title, body; assets: doc_id, ord, src, content; errors: doc_id, error."""

    segments: DataFrame
    assets: DataFrame
    errors: DataFrame


def convert(docs: DataFrame) -> Converted:
    """Documents (doc_id, format, content; for PDF, where an extractor gave them, xml and outline) to their parts.

    Each format is a branch of one plan. A document that can't be read, or is of no known format, gives an error and
    doesn't stop the others.
    """
    for name in ("xml", "outline"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    text = as_text(F.col("content"))
    of = lambda *kinds: docs.filter(F.col("format").isin(*kinds))
    plain = of("md").select("doc_id", text.alias("text"))
    plain = plain.unionByName(of("txt").select("doc_id", promote_headings(text).alias("text")))
    pages_ = settled(of("html").select("doc_id", html.converted(text).alias("page")))
    plain = plain.unionByName(pages_.filter("page.error IS NULL").select("doc_id", F.col("page.markdown").alias("text")))

    parsed = settled(archives.parsed(docs))
    plain = plain.unionByName(parsed.filter("kind = 'text'").select("doc_id", F.col("body").alias("text")))
    chapters = parsed.filter("kind = 'segment'").select("doc_id", "ord", "title", written(F.col("title"), F.col("body")).alias("body"))

    found = settled(pdf.items(of("pdf")))
    lines = pdf_model.visual_lines(pdf.runs(found), pdf.images(found))
    given = of("pdf").filter("outline IS NOT NULL")
    marks = pdf.bookmarks(given).unionByName(pdf.own_bookmarks(found).join(given.select("doc_id"), "doc_id", "left_anti"))
    pages = pdf_model.segments(lines, marks)
    pages = settled(pages.select("doc_id", "ord", "title", written(F.col("title"), F.col("content")).alias("body")))

    media = parsed.filter("kind = 'asset'").select("doc_id", "ord", F.col("path").alias("src"), "content")
    # of a PDF's pictures those that its segments show
    media = media.unionByName(pdf.pictures(found).join(assets_.local_references(pages).select("doc_id", "src"), ["doc_id", "src"], "left_semi").select("doc_id", "ord", "src", "content"))
    unknown = docs.filter(F.col("format").isNull() | ~F.col("format").isin("md", "txt", "html", "docx", "epub", "pdf"))
    failed = parsed.filter("kind = 'error'").select("doc_id", "error").unionByName(found.filter("kind = 'error'").select("doc_id", "error"))
    failed = failed.unionByName(pages_.filter("page.error IS NOT NULL").select("doc_id", F.col("page.error").alias("error")))
    failed = failed.unionByName(unknown.select("doc_id", F.format_string("unknown format: %s", F.coalesce("format", F.lit(""))).alias("error")))
    all_ = settled(segments(plain).select(SEGMENT).unionByName(chapters).unionByName(pages.select(SEGMENT)))  # read twice: for what it shows, and as it is
    return Converted(assets_.relink(all_, media).select(SEGMENT), media, failed)


@dataclass
class Published:
    """files: job_id, path, content of publishable bundles; reports: of all converted jobs; failed: job_id, error."""

    files: DataFrame
    reports: DataFrame
    failed: DataFrame


def publish(jobs: DataFrame, canceled: DataFrame | None = None) -> Published:
    """Converts jobs (job_id, original_name, format, content, converted_at), builds and validates their bundles.

    Jobs canceled meanwhile (job_id) are left out before anything is built; only publishable bundles give files.
    """
    if canceled is not None:
        jobs = jobs.join(canceled.select("job_id").distinct(), "job_id", "left_anti")
    parts = convert(jobs.withColumnRenamed("job_id", "doc_id"))
    done = settled(parts.segments.withColumnRenamed("doc_id", "job_id"))
    named = assets_.named_assets(parts.assets).select(F.col("doc_id").alias("job_id"), "name", "content")
    failed = parts.errors.withColumnRenamed("doc_id", "job_id")
    good = jobs.join(failed.select("job_id"), "job_id", "left_anti")
    files = settled(bundles.bundle_files(done, good, named))  # written, and read by the validation
    text = files.withColumn("content", F.when(F.col("path").endswith(".md"), as_text(F.col("content"))))
    reports = validation.reports(text, good)
    keep = validation.publishable(reports).select("job_id")
    return Published(files.join(keep, "job_id", "left_semi"), reports, failed)


def write_bundles(files: DataFrame, path: str, jobs: DataFrame | None = None, canceled: DataFrame | None = None) -> None:
    """Writes bundles in order of their jobs, so a bundle is read from few row groups; with jobs (job_id, user_id), by folders
    of users. Tasks hold ranges of jobs, so there are about as many part files as tasks, however many jobs there are.

    canceled (job_id) is read now, after the build: what was canceled meanwhile isn't written.
    """
    if canceled is not None:
        files = files.join(canceled.select("job_id").distinct(), "job_id", "left_anti")
    by = ["job_id"]
    if jobs is not None:
        files, by = files.join(jobs.select("job_id", "user_id"), "job_id"), ["user_id", "job_id"]
    writer = files.repartitionByRange(*by).sortWithinPartitions(*by, "path").write.mode("overwrite")
    (writer if jobs is None else writer.partitionBy("user_id")).parquet(path)


def register(out: Published, jobs: DataFrame, path: str) -> DataFrame:
    """job_id, path, validation, warnings of the bundles that stand in path: a job whose files weren't all written is not
    registered, so a run that breaks off between the two leaves no bundle that is only half there.
    """
    spark = jobs.sparkSession
    written = spark.read.parquet(path).groupBy("job_id").agg(F.count("*").alias("files"))
    whole = out.files.groupBy("job_id").agg(F.count("*").alias("files")).join(written, ["job_id", "files"]).select("job_id")
    done = jobs.select(F.col("job_id").alias("id"), "user_id", F.lit("completed").alias("status"))
    return jobs_.registered(done, out.reports.join(whole, "job_id"))
