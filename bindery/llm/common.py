"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The tables that stored() has written and discard() has not removed.
TABLES: list[str] = []
#: A key with more than one in so many rows is hot: there are fewer such keys than this.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without the setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="bindery-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; a lost executor costs a read, not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: columnar and compressed, for wider rows than cut() suits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that stored() wrote. Nothing that is still to be computed may read them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        TABLES.remove(path)


def release() -> None:
    """Gives memory that this Python worker no longer uses back to the machine: it lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has other ways
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def meet(rows: DataFrame, facts: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """rows joined with facts, which has a row per key and how many of the `total` rows have it as `count`.

    Keys of over a thousandth of the rows, fewer than a thousand, are broadcast, so that their rows stay where they lie;
    only the others are shuffled. facts is read three times, so it should be stored.
    """
    hot = F.col(count) * HOT_SHARE > total
    heavy = F.broadcast(facts.filter(hot))
    light = rows.join(heavy.select(key), key, "left_anti").join(facts.filter(~hot), key)
    return rows.join(heavy, key).unionByName(light)


def numbered(rows: DataFrame, key: list[str], order: list[str | Column], name: str) -> DataFrame:
    """rows, which should be stored, with the column `name`: each row's place, from 0, among those of its key, by `order`.

    Rows are sorted by ranges, so that a key's rows may lie in many tasks. Where a task's rows of a key begin is broadcast:
    a row for each task and for each further key that a task holds, so keys should be few. Equal rows come in any order.
    """
    tie = F.monotonically_increasing_id()
    at, part = unused(rows.columns, "at"), unused(rows.columns, "part")
    in_order = rows.withColumn(at, tie).repartitionByRange(*key, *order, at).sortWithinPartitions(*key, *order, at)
    placed = stored(in_order.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    begins = placed.groupBy(*key, part).agg(F.min(at).alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")
    own = placed.select(F.struct(*rows.columns).alias("row"), F.struct(*key, part).alias("of"), F.col(at).alias("place"))
    shifts = F.broadcast(begins.select(F.struct(*key, part).alias("begin"), shift.alias("shift")))
    return own.join(shifts, F.col("of").eqNullSafe(F.col("begin"))).select("row.*", (F.col("place") + F.col("shift")).alias(name))


def unused(columns: list[str], name: str) -> str:
    """`name`, or with a number where the columns have it already, in any case of letters."""
    taken = {c.lower() for c in columns}
    return next(n for k in range(len(taken) + 1) if (n := f"{name}_{k}") not in taken)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sampled(df: DataFrame, key: Column, rows: int, limit: int) -> DataFrame:
    """About `limit` of `rows` rows (all if they are fewer), picked by a hash of `key`, the same ones each time."""
    if rows <= limit:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int((1 << 30) * limit / rows))


def input_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; sizes the number of buckets so that each one fits a task."""
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
