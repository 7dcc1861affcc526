"""Helpers on whole DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without the setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="bindery-"))
    return sc.getCheckpointDir()


#: The tables that settled() has written and scratch() has not removed.
SETTLED: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """df, computed once as a Parquet table in the shared folder, so that each of several uses reads the columns it needs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were settled within, at its end: what reads them has to be written by then."""
    begin = len(SETTLED)
    try:
        yield
    finally:
        for path in SETTLED[begin:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del SETTLED[begin:]
