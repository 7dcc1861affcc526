"""Documents from a folder of uploads, in batch or as a stream."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions.text import extension_of, parse_format
from bindery.schema import MAX_UPLOAD


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, name, format, length, content of each file of a known format within the size limit, from all subfolders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return accepted(raw)


def upload_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return accepted(raw)


def accepted(raw: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return raw.filter(F.col("length") <= MAX_UPLOAD).select("path", name.alias("name"), parse_format(extension_of(name)).alias("format"), "length", "content").filter("format IS NOT NULL")


def listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """path, key of each file below a folder whose key, its path from there, begins with prefix; contents aren't read."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    folder = re.sub(scheme, "", path).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.substring(F.regexp_replace("path", scheme, ""), len(folder) + 1, 1 << 30)
    return files.select("path", key.alias("key")).filter(F.col("key").startswith(prefix.lstrip("/")))


def upload(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The file of that very key below a folder, as `accepted` gives it: only this file is listed and read."""
    return accepted(spark.read.format("binaryFile").load(f"{path.rstrip('/')}/{key.lstrip('/')}"))


def as_text(content: Column) -> Column:
    """UTF-8 text; bytes that are none become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))
