"""The job queue as streams: messages to claims and dead letters, events to job states."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from bindery.functions.frames import scratch
from bindery.operators.jobs import TRANSITIONS, decoded

STATE = "job_id string, status string, error_message string, applied long"


def message_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder, decoded, with the time of their reading."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return decoded(raw.withColumn("read_at", F.current_timestamp()))


def run_claims(messages: DataFrame, convert, claims_path: str, dead_path: str, checkpoint: str, forget_after: str = "1 day") -> StreamingQuery:
    """Writes convert(claims) and the dead letters of each micro-batch; a repeated job_id within forget_after is dropped.

    What is no message goes to the dead letters as it is and enters no state. Where convert gives a column `error`, the
    messages of its rows that have one go there too, after the job_id, and the others of their batch go on.
    A batch that is run again after a failure writes to the same folders, so its results replace what it left behind.
    """
    known = messages.withWatermark("read_at", forget_after)
    live = known.filter("NOT dead").withColumn("job_id", F.col("msg.job_id")).dropDuplicatesWithinWatermark(["job_id"])
    once = live.unionByName(known.filter("dead").withColumn("job_id", F.lit(None).cast("string")))

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            written(batch.persist(), batch_id)

    def written(batch: DataFrame, batch_id: int) -> None:
        try:
            done = convert(batch.filter("NOT dead").select("msg.*"))
            dead = batch.filter("dead").select("value")
            if "error" in done.columns:
                done = done.persist()
                failed = done.filter("error IS NOT NULL").select("job_id").distinct()
                dead = dead.unionByName(batch.filter("NOT dead").join(failed, "job_id").select("value"))
                done.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{claims_path}/batch={batch_id}")
            else:
                done.write.mode("overwrite").parquet(f"{claims_path}/batch={batch_id}")
            dead.write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
            done.unpersist()
        finally:
            batch.unpersist()

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stepped(state: tuple[str, str, int], event: str, error: str | None) -> tuple[str, str, int]:
    """One event on (status, error_message, applied); the batch fold's rule, for rows that come one after the other."""
    guard, to = TRANSITIONS.get(event, ((), state[0]))
    if guard is not None and state[0] not in guard:
        return state
    return to, (error or "") if event == "fail" else state[1], state[2] + 1


#: States that only a late event can still change.
TERMINAL = ("completed", "failed", "canceled")
#: A job without events: status, error_message, applied, and the time of its last event.
NEW = ("pending", "", 0, 0)
#: The state's blocks of jobs, and the events that a block should hold at most; a block costs a micro-batch some ten milliseconds.
BLOCKS, BLOCK_EVENTS = 256, 1 << 14
#: pandas has no times from here on.
LATEST = "2262-01-01"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def marked(watermark_ms: int) -> int:
    """The watermark in microseconds; 0 stands for none yet."""
    return watermark_ms * 1000 or -(1 << 62)


def advanced(mark: int, before: tuple, events: list) -> tuple[tuple, list, tuple]:
    """A job's state with all events (ts, seq, event, error) up to the mark in it, the others in order, and the state after those too."""
    *start, last = before
    events = sorted(events)
    now, due = tuple(start), 0
    while due < len(events) and events[due][0] <= mark:
        now = stepped(now, *events[due][2:])
        due += 1
    settled, waiting = (*now, max(last, events[-1][0]) if events else last), events[due:]
    for _, _, event, error in waiting:
        now = stepped(now, event, error)
    return settled, waiting, now


def forgotten_at(status: str, last: int, keep_ms: int, watermark_ms: int) -> int | None:
    """When a job is forgotten: `keep` after its last event, if it is terminal, but not before the watermark moves on."""
    return max(last // 1000 + keep_ms, watermark_ms + 1) if status in TERMINAL else None


class JobProcessor(StatefulProcessor):
    """A job's state is what the events up to the watermark make of it, and the events after it, in no order yet.

    Each update folds the latter, sorted, on the former, so events may come in any order as long as none is later than the
    watermark allows; those that are change nothing. A terminal job is forgotten `keep` after its last event.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "status string, error string, applied long, last long")
        self.open = handle.getListState("open", "ts long, seq long, event string, error string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        mark = marked(watermark)
        fresh = [(r["micros"], r["seq"], r["event"] or "", r["error_message"] or "") for r in rows if r["micros"] > mark]
        # each call on the state is a round trip to the JVM: a job that is new has neither open events nor timers to ask for
        before = self.settled.get()
        held = [tuple(x) for x in self.open.get()] if before is not None else []
        settled, waiting, now = advanced(mark, before or NEW, held + fresh)
        self.settled.update(settled)
        if waiting:
            self.open.put(waiting)  # in place of what it held
        elif held:
            self.open.clear()
        for at in self.handle.listTimers() if before is not None else ():
            self.handle.deleteTimer(at)
        if until := forgotten_at(now[0], settled[-1], self.keep_ms, watermark):
            self.handle.registerTimer(until)
        yield Row(job_id=key[0], status=now[0], error_message=now[1], applied=now[2])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.settled.clear()
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


class BlockProcessor(StatefulProcessor):
    """JobProcessor's states and results for a block of jobs: a key is a block, and its value holds all its jobs.

    A micro-batch reads and writes a block once, however many of its jobs it touches. Its timer is that of the job that is
    forgotten next.
    """

    def __init__(self, keep_ms: int, blocks: int) -> None:
        self.keep_ms, self.blocks = keep_ms, blocks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # jobs: JSON, a list for each job of its id, NEW's four fields, when it is forgotten, and its open events
        self.block = handle.getValueState("block", "jobs string, timer long, blocks int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        mark, fresh = marked(watermark), defaultdict(list)
        for part in rows:
            for e in json.loads(f"[{','.join(part['message'])}]"):
                touched, micros = fresh[e.get("job_id")], e.get("micros")
                if micros > mark:
                    touched.append([micros, e.get("seq"), e.get("event") or "", e.get("error_message") or ""])
        jobs, timer = self.held()
        out = []
        for job_id, events in fresh.items():
            *before, _, held = jobs.get(job_id) or (*NEW, None, [])
            settled, waiting, now = advanced(mark, before, held + events)
            jobs[job_id] = (*settled, forgotten_at(now[0], settled[-1], self.keep_ms, watermark), waiting)
            out.append((job_id, *now))
        self.hold(jobs, timer)
        yield pd.DataFrame(out, columns=["job_id", "status", "error_message", "applied"])

    def held(self) -> tuple[dict, int | None]:
        """The block's jobs, and its timer."""
        found = self.block.get()
        if found is None:
            return {}, None
        jobs, timer, blocks = found
        if blocks != self.blocks:
            raise ValueError(f"the state has its jobs in {blocks} blocks, not in {self.blocks}")
        return {job_id: job for job_id, *job in json.loads(jobs)}, timer

    def hold(self, jobs: dict, timer: int | None) -> None:
        due = min((until for *_, until, _ in jobs.values() if until is not None), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if jobs:
            self.block.update((json.dumps([(job_id, *job) for job_id, job in jobs.items()], separators=(",", ":")), due, self.blocks))
        else:
            self.block.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        jobs, _ = self.held()
        self.hold({job_id: job for job_id, job in jobs.items() if job[-2] is None or job[-2] > watermark}, None)  # Spark deletes the timer
        return iter(())

    def close(self) -> None:
        pass


def job_states(events: DataFrame, delay: str = "1 hour", keep_seconds: int = 7 * 86400, blocks: int | None = BLOCKS) -> DataFrame:
    """STATE rows of each job that an update of the stream (job_id, ts, seq, event, error_message) touches: what the batch
    fold makes of all events so far, in order of ts and seq.

    Events may be late by `delay` against the latest one; later ones are left out. Terminal jobs are forgotten keep_seconds
    (no less than the delay) after their last event, so the state holds the jobs at work and the latest ones; an event that
    comes after that begins anew. Spark's own time to live runs by the clock, this by the events, so that a stream that is
    read again ends alike.

    The state is held by blocks of jobs, as a call on it costs more than a job's fold: a micro-batch reads and writes the blocks
    that it touches as wholes, so where BLOCKS would hold more than BLOCK_EVENTS each, give more. A checkpoint keeps the number
    that it began with. blocks=None holds each job alone, for micro-batches of few events on a large state.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # a watermark begins at the epoch, and what isn't after it would be late from the start
    at = F.least(F.greatest("ts", F.timestamp_millis(F.lit(1))), F.lit(LATEST).cast("timestamp"))
    timed = events.withColumn("at", at).withWatermark("at", delay)
    fields = ["job_id", F.unix_micros("ts").alias("micros"), F.col("seq").cast("long").alias("seq"), "event", "error_message"]
    if blocks is None:
        return timed.select("at", *fields).groupBy("job_id").transformWithState(JobProcessor(keep_seconds * 1000), STATE, "Update", "EventTime")
    block = F.pmod(F.xxhash64("job_id"), F.lit(blocks)).alias("block")
    message = F.to_json(F.struct(*fields)).alias("message")  # a cell where Python would convert five
    return timed.select(block, "at", message).groupBy("block").transformWithStateInPandas(BlockProcessor(keep_seconds * 1000, blocks), STATE, "Update", "EventTime")
