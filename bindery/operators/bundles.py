"""Bundles: index, log, concepts and assets as rows of files; export as archives and listings."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.operators.segments import segment_file

#: The product's name as it stands in texts and file names; set it to another deployment's to get its very files.
PRODUCT = "bindery"

#: The texts of index.md and log.md.
INDEX_HEAD = "# Índice del Bundle %s\n\n| # | Título | Archivo |\n|---|--------|---------|\n"
LOG_HEAD = "# Log de Conversión\n\n"
LOG_KEYS = ("Job ID", "Archivo original", "Formato", "SHA-256 (original)", "Tamaño (bytes)", "Conceptos generados", "Recursos extraídos", "Fecha de conversión", "Motor")

#: Content types, of bundle files and of uploads.
BUNDLE_TYPES = {"md": "text/markdown; charset=utf-8", "html": "text/html; charset=utf-8", "htm": "text/html; charset=utf-8", "json": "application/json", "txt": "text/plain; charset=utf-8"}
UPLOAD_TYPES = {
    "md": "text/markdown; charset=utf-8", "txt": "text/plain; charset=utf-8", "html": "text/html; charset=utf-8", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "epub": "application/epub+zip",
}


def index_row(ord_: Column, title: Column, file: Column) -> Column:
    return F.concat(F.lit("| "), ord_.cast("string"), F.lit(" | "), F.replace(title, F.lit("|"), F.lit("\\|")), F.lit(" | ["), file, F.lit("](conceptos/"), file, F.lit(") |\n"))


def index_files(segments: DataFrame, key: str = "job_id", product: str = PRODUCT) -> DataFrame:
    """key, path, content of each bundle's index.md, from (key, ord, title)."""
    rows = F.sort_array(F.collect_list(F.struct("ord", index_row(F.col("ord"), F.col("title"), segment_file(F.col("ord"))).alias("row"))))
    return segments.groupBy(key).agg(F.concat(F.lit(INDEX_HEAD % product), F.array_join(F.transform(rows, lambda r: r["row"]), "")).alias("content")).select(key, F.lit("index.md").alias("path"), "content")


def log_text(job_id: Column, name: Column, kind: Column, content: Column, concepts: Column, assets: Column, at: Column, product: str = PRODUCT) -> Column:
    """log.md of a job; a missing content has hash 'unknown' and size 0."""
    values = (job_id, name, F.upper(kind), F.coalesce(F.sha2(content, 256), F.lit("unknown")), F.coalesce(F.octet_length(content), F.lit(0)).cast("string"), concepts.cast("string"), assets.cast("string"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f"{product.lower()}-worker"))
    return F.concat(F.lit(LOG_HEAD), *[F.concat(F.lit(f"- **{k}:** "), F.coalesce(v, F.lit("")), F.lit("\n")) for k, v in zip(LOG_KEYS, values, strict=True)])


def bundle_files(segments: DataFrame, jobs: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """job_id, path, content (binary) of every file, from segments (job_id, ord, title, body), jobs (job_id,
    original_name, format, content, converted_at) and named assets (job_id, name, content)."""
    concepts = segments.select("job_id", F.concat(F.lit("conceptos/"), segment_file(F.col("ord"))).alias("path"), F.col("body").cast("binary").alias("content"))
    index = index_files(segments).withColumn("content", F.col("content").cast("binary"))
    counts = segments.groupBy("job_id").agg(F.count("*").alias("concepts"))
    logged = jobs.join(counts, "job_id", "left")
    if assets is not None:
        logged = logged.join(assets.groupBy("job_id").agg(F.count("*").alias("assets")), "job_id", "left")
        files = concepts.unionByName(assets.select("job_id", F.concat(F.lit("assets/"), "name").alias("path"), "content"))
    else:
        logged, files = logged.withColumn("assets", F.lit(0)), concepts
    text = log_text(*map(F.col, ("job_id", "original_name", "format", "content")), F.coalesce("concepts", F.lit(0)), F.coalesce("assets", F.lit(0)), F.col("converted_at"))
    log = logged.select("job_id", F.lit("log.md").alias("path"), text.cast("binary").alias("content"))
    return files.unionByName(index).unionByName(log)


def content_type(path: Column, kinds: dict[str, str] = BUNDLE_TYPES) -> Column:
    extension, out = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit("application/octet-stream")
    for k, v in kinds.items():
        out = F.when(extension == k, v).otherwise(out)
    return out


def clean_path(path: Column) -> Column:
    """Whether a requested path is one of a bundle's own: relative, clean, never upward."""
    return (path != "") & ~path.rlike(r"^/|//|/$|(?:^|/)\.{1,2}(?:/|$)|\\")


def file_listing(files: DataFrame) -> DataFrame:
    """job_id, path, url, content_type of each file."""
    return files.select("job_id", "path", F.concat(F.lit("/api/v1/jobs/"), "job_id", F.lit("/bundle/"), "path").alias("url"), content_type(F.col("path")).alias("content_type"))


def export_file(files: DataFrame, job_id: str, path: str) -> DataFrame:
    """The content of one file; no row for a path that isn't clean or isn't there."""
    return files.filter((F.col("job_id") == job_id) & (F.col("path") == path) & clean_path(F.lit(path)))


def archives(files: DataFrame, jobs: DataFrame, product: str = PRODUCT) -> DataFrame:
    """job_id, name, archive: a ZIP of each bundle in one row. Where bundles may be large, `exports.archive_parts` gives it in parts."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in sorted(zip(pdf["path"], pdf["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(path), bytes(content))
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "archive": [out.getvalue()]})

    named = jobs.select("job_id", F.concat(F.regexp_replace("original_name", r"\.[^.]*$", ""), F.lit(f"-{product.lower()}.zip")).alias("name"))
    return files.select("job_id", "path", "content").groupBy("job_id").applyInPandas(build, "job_id string, archive binary").join(named, "job_id").select("job_id", "name", "archive")
