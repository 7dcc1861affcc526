"""Bundles that become visible whole or not at all.

A run writes its files into a staging folder, asks once more what was canceled, moves the folder in place, and writes its
manifest last: a row for each job with the number, bytes and digest of its files. Readers and the registration know only
what manifests name, so a run that breaks off anywhere leaves nothing that can be seen, and may be run again under its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "job_id string, user_id string, files long, bytes long, digest long"
FILES = "job_id string, user_id string, path string, content binary"


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder, on the file system of its path; False if the target is there already. A failed move is an error."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(b):
        return False
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} can't be moved to {target}")
    return True


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def summary(files: DataFrame) -> DataFrame:
    """MANIFEST rows of files (FILES). The digest is of all paths and contents, in no order."""
    each = F.xxhash64("path", "content")
    return files.groupBy("job_id", "user_id").agg(F.count("*").alias("files"), F.sum(F.octet_length("content").cast("long")).alias("bytes"), F.bit_xor(each).alias("digest"))


def commit(files: DataFrame, jobs: DataFrame, path: str, run: str, canceled: Callable[[], DataFrame] | None = None) -> bool:
    """Writes the bundles in files (job_id, path, content) of jobs (job_id, user_id) as the run's; False if it was committed
    before, so a run that is done again changes nothing.

    canceled gives (job_id) at the time that it is called: before the files are written, and once more when they stand in
    staging. If jobs were canceled between the two, staging is written anew without them, and no file of theirs is left.
    """
    spark = files.sparkSession
    staging, data, manifest = f"{path}/staging/{run}", f"{path}/data/run={run}", f"{path}/manifests/run={run}"
    if exists(spark, manifest):
        removed(spark, staging)
        return False
    removed(spark, data)  # of a run that broke off before its manifest
    removed(spark, staging)
    rows = files.join(jobs.select("job_id", "user_id"), "job_id").select("job_id", F.col("user_id").cast("string").alias("user_id"), "path", F.col("content").cast("binary").alias("content"))

    def alive(rows: DataFrame) -> DataFrame:
        return rows if canceled is None else rows.join(canceled().select("job_id").distinct(), "job_id", "left_anti")

    def write(rows: DataFrame, at: str) -> DataFrame:
        rows.repartitionByRange("job_id").sortWithinPartitions("job_id", "path").write.mode("overwrite").parquet(at)
        return spark.read.schema(FILES).parquet(at)

    at, n = f"{staging}/0", 0
    stand = write(alive(rows), at)
    while canceled is not None and stand.select("job_id").join(canceled().select("job_id").distinct(), "job_id", "left_semi").limit(1).count():
        n += 1
        at = f"{staging}/{n}"
        stand = write(alive(stand), at)
    summary(stand).write.mode("overwrite").parquet(f"{staging}/manifest")
    moved(spark, at, data)
    moved(spark, f"{staging}/manifest", manifest)
    removed(spark, staging)
    return True


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """MANIFEST rows with run: of each job the one of its latest run by name."""
    at = f"{path}/manifests"
    if not exists(spark, at):
        return spark.createDataFrame([], f"{MANIFEST}, run string")
    found = spark.read.schema(f"{MANIFEST}, run string").parquet(at)
    latest = Window.partitionBy("job_id").orderBy(F.desc("run"))
    return found.withColumn("place", F.row_number().over(latest)).filter("place = 1").drop("place")


def visible(spark: SparkSession, path: str) -> DataFrame:
    """job_id, user_id, path, content of all committed bundles; of a job that was run again, the latest."""
    if not exists(spark, f"{path}/data"):
        return spark.createDataFrame([], FILES)
    named = manifests(spark, path).select("job_id", "run")
    return spark.read.schema(f"{FILES}, run string").parquet(f"{path}/data").join(named, ["job_id", "run"], "left_semi").drop("run")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """job_id of manifests that the files don't bear out, in number, bytes or digest."""
    named = manifests(spark, path).drop("run")
    return named.join(summary(visible(spark, path)), ["job_id", "user_id", "files", "bytes", "digest"], "left_anti").select("job_id")


def registrations(spark: SparkSession, path: str, reports: DataFrame) -> DataFrame:
    """job_id, path, validation, warnings of the committed bundles with a publishable report (job_id, level, warnings)."""
    none = F.array().cast("array<string>")
    named = manifests(spark, path).join(reports.filter("level <> 'invalid'"), "job_id")
    return named.select("job_id", F.concat_ws("/", F.lit("bundles"), "user_id", "job_id").alias("path"), F.col("level").alias("validation"), F.coalesce("warnings", none).alias("warnings"))
