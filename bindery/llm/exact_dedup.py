"""Operator 7, exact dedup: a heavy-hitter split.

Misra-Gries counters find the digests that may be frequent; an exact count verifies them; those winners, at most
`counters` rows, are broadcast and their copies are settled where they lie. Only the other digests are shuffled,
of which none has more than 2 / (counters + 1) of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import cut, unused

COUNTERS = 1024


def misra_gries(keys, counters: int) -> dict:
    """At most `counters` keys with lower bounds of their counts, each at most n / (counters + 1) too low."""
    held: dict = {}
    for key in keys:
        if key in held:
            held[key] += 1
        elif len(held) < counters:
            held[key] = 1
        else:
            held = {k: v - 1 for k, v in held.items() if v > 1}
    return held


def frequent(df: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` values of the string column `key`, all those with over 2n / (counters + 1) of n rows among them.

    Each partition's summary misses a key by at most its own n / (counters + 1), so the sums miss by n / (counters + 1),
    and no more than `counters` sums can exceed that.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((x for b in batches for x in b.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(held), pa.string()), "weight": pa.array(list(held.values()), pa.int64())})

    parts = df.select(key).mapInArrow(summary, "key string, weight long")
    return parts.groupBy(F.col("key").alias(key)).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), key).limit(counters).select(key)


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest doc_id stays; a null doc_id is the smallest, and
    of rows that repeat doc_id and text exactly one is kept. An empty table gives an empty result. Other columns of docs
    are ignored, whatever their names.
    """
    keyed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256")))
    candidates = frequent(keyed, "text_sha256", counters)
    winners = cut(keyed.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    heavy = keyed.join(F.broadcast(winners), "text_sha256")
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    one = Window.partitionBy("text_sha256").orderBy("doc_id")
    heavy_kept = heavy.filter(wins).withColumn("kept", F.row_number().over(one) == 1).select(columns)
    heavy_dropped = heavy.filter(~wins).withColumn("kept", F.lit(False)).select(columns)
    group = Window.partitionBy("text_sha256")
    light = (
        keyed.join(F.broadcast(winners), "text_sha256", "left_anti")
        .withColumn("keep_id", F.max("doc_id").over(group))
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("kept", F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())) == 1)
        .select(columns)
    )
    return heavy_dropped.unionByName(heavy_kept).unionByName(light)


def deduplicated(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. Of rows that repeat doc_id and text any one stays."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    found = cut(exact_dedup(docs, counters).select(F.col("doc_id").alias("_drop_id"), F.col("text_sha256").alias("_drop_sha"), "kept", "keep_id"))
    # only what goes is sent, and of rows like the one that stays none goes here
    gone = found.filter(~F.col("kept") & ~F.col("_drop_id").eqNullSafe(F.col("keep_id")))
    rows = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_drop_id"]) & (digest == gone["_drop_sha"]), "left_anti")
    repeated = found.filter(~F.col("kept") & F.col("_drop_id").eqNullSafe(F.col("keep_id"))).limit(1).count()
    if not repeated:
        return rows
    same = unused(rows.columns, "same")
    return rows.withColumn(same, F.coalesce(F.col("text"), F.lit(""))).dropDuplicates(["doc_id", same]).drop(same)
