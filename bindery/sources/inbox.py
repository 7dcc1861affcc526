"""Uploads in a folder of many objects: listed by tasks, and each object taken once.

A manifest knows the objects that earlier runs took, by path, time and length. A run lists the folder level by level, each
folder in a task, takes what no manifest knows, and writes its own manifest last: a run that breaks off before takes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions.frames import settled
from bindery.plans.commit import exists, moved, removed
from bindery.schema import MAX_UPLOAD
from bindery.sources.files import accepted

OBJECT = "path string, modificationTime timestamp, length long"
#: Objects in a batch that a folder's listing gives.
BATCH = 10_000


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path or URI, the path there, and what comes before that path in the URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: path.rindex(inner)] if path.endswith(inner) else path.partition(inner)[0]


def entries(folders: DataFrame) -> DataFrame:
    """path, folder, modificationTime, length of what stands in folders (path) itself, but for names that begin with a dot or
    an underline, which Spark's readers leave out too. A folder that is gone meanwhile has nothing in it.
    """
    kinds = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, inner, before = opened(path)
                found = [i for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if i.base_name[0] not in "._"]
                for k in range(0, len(found), BATCH):
                    part = found[k : k + BATCH]
                    folder = [i.type == fs.FileType.Directory for i in part]
                    columns = [before + i.path for i in part], folder, [i.mtime for i in part], [0 if d else i.size for d, i in zip(folder, part, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    return folders.select("path").mapInArrow(read, "path string, folder boolean, modificationTime timestamp, length long")


def listed(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """OBJECT rows of all files below a folder, or below one of its folders, `prefix`. A level's folders are listed by as many
    tasks as the cluster has cores; the driver sees whether a level has folders, and no names.
    """
    root = "/".join(p for p in (path.rstrip("/"), prefix.strip("/")) if p)
    level, out = spark.createDataFrame([(root,)], "path string"), spark.createDataFrame([], OBJECT)
    while not level.isEmpty():
        found = settled(entries(level.repartition(spark.sparkContext.defaultParallelism, "path")))
        out = out.unionByName(found.filter("NOT folder").drop("folder"))
        level = found.filter("folder").select("path")
    return out


def known(spark: SparkSession, manifests: str) -> DataFrame:
    """OBJECT rows that earlier runs took."""
    return spark.read.schema(OBJECT).parquet(f"{manifests}/run=*") if runs(spark, manifests) else spark.createDataFrame([], OBJECT)


def runs(spark: SparkSession, manifests: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{manifests}/run=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def fresh(spark: SparkSession, path: str, manifests: str, prefix: str = "") -> DataFrame:
    """OBJECT rows that no run took: new paths, and known ones with another time or length. Computed once, so that a run works
    on, and later tells as taken, the very same objects, whatever comes meanwhile.
    """
    return settled(listed(spark, path, prefix).join(known(spark, manifests), ["path", "modificationTime", "length"], "left_anti"))


def take(objects: DataFrame, manifests: str, run: str) -> bool:
    """Tells that a run's objects are taken, in one step; False if the run told so before, which changes nothing."""
    spark = objects.sparkSession
    staging, manifest = f"{manifests}/_{run}", f"{manifests}/run={run}"
    if exists(spark, manifest):
        return False
    removed(spark, staging)
    objects.select("path", "modificationTime", "length").write.parquet(staging)
    moved(spark, staging, manifest)
    return True


def contents(objects: DataFrame) -> DataFrame:
    """Uploads as `files.accepted` gives them, of OBJECT rows. Only objects within the size limit are read; one that has changed
    its length since it was listed, or is gone, is left for the run that lists it next.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, inner, _ = opened(path)
                try:
                    with system.open_input_stream(inner) as f:
                        data = f.read(length + 1)
                except FileNotFoundError:
                    continue
                if len(data) == length:
                    yield pa.RecordBatch.from_pydict({"path": [path], "length": pa.array([length], pa.int64()), "content": pa.array([data], pa.binary())})

    small = accepted(objects.withColumn("content", F.lit(b""))).select("path", "length")
    return accepted(small.filter(F.col("length") <= MAX_UPLOAD).mapInArrow(read, "path string, length long, content binary"))
