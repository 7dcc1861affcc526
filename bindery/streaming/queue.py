"""A folder as the job queue: a sink that sends each message once, and admission of as much work as may be in flight."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bindery.operators.jobs import messages
from bindery.plans.commit import exists, moved, removed

ATTEMPTS = 2


def written(batch: DataFrame, path: str) -> None:
    batch.select("value").write.mode("overwrite").text(path)


def deliver(batch: DataFrame, queue: str, name: str, send: Callable[[DataFrame, str], None] = written, attempts: int = ATTEMPTS) -> int:
    """Sends the messages (value) as one delivery, which the queue shows as a whole or not at all; the number of the attempt
    that did it, 0 if a delivery of this name is there already.

    What an attempt leaves behind when it fails lies beside the queue and is never read. After the last one its error stands.
    """
    spark, target = batch.sparkSession, f"{queue}/delivery={name}"
    if exists(spark, target):
        return 0
    for attempt in range(1, attempts + 1):
        staging = f"{queue.rstrip('/')}.staging/{name}-{attempt}"
        try:
            removed(spark, staging)
            send(batch, staging)
            moved(spark, staging, target)
            return attempt
        except Exception:
            removed(spark, staging)
            if attempt == attempts:
                raise
    return 0


def publish(jobs: DataFrame, queue: str, checkpoint: str, known_for: str = "1 day", send: Callable[[DataFrame, str], None] = written) -> StreamingQuery:
    """Sends a message for each job of the stream (id, user_id, format, object_key, attempt).

    The delivery key is the job and its attempt: of rows with the same key within known_for one is sent. A micro-batch is a
    delivery under its own number, so one that runs again after a failure finds it sent.
    """
    keyed = jobs.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", known_for)
    once = keyed.dropDuplicatesWithinWatermark(["id", "attempt"])

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            if not rows.isEmpty():
                deliver(messages(rows), queue, f"{batch_id:010d}", send)
        finally:
            rows.unpersist()

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def wave(order: list[Column], size: Column, most: int, most_bytes: int, largest: int) -> Column:
    """The number of the wave that takes a message: no wave has more than `most` messages, nor more than most_bytes, where no
    message has more than `largest` bytes. Where a message alone may fill a wave, each has one of its own.
    """
    rows = Window.orderBy(*order)
    place = F.row_number().over(rows) - 1
    if largest >= most_bytes:
        return place
    before = F.coalesce(F.sum(size).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # what begins within a span of most_bytes - largest ends within most_bytes
    return F.floor(place / most) + F.floor(before / (most_bytes - largest))


def waves(batch: DataFrame, order: list[Column], size: Column, most: int, most_bytes: int, largest: int) -> Iterator[DataFrame]:
    """The messages of a micro-batch, so many of them and so many bytes at a time, in order. A micro-batch is no larger than
    its source admits, and only the order and sizes of its messages meet in one task.
    """
    numbered = batch.withColumn("wave_", wave(order, size, most, most_bytes, largest)).persist()
    try:
        for (n,) in numbered.select("wave_").distinct().orderBy("wave_").collect():
            yield numbered.filter(F.col("wave_") == n).drop("wave_")
    finally:
        numbered.unpersist()
