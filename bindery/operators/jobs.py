"""The job lifecycle as a fold over an event log, and the lookups on jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each event's guard (states in which it takes effect; None: any) and the state it leads to.
TRANSITIONS = {
    "claim": (("pending",), "processing"),
    "cancel": (("pending", "processing"), "canceled"),
    "complete": (("pending", "processing", "completed", "failed"), "completed"),
    "fail": (("pending", "processing", "completed", "failed"), "failed"),
    "publish_error": (None, "failed"),
}
CANCELABLE, RETRYABLE = ("pending", "processing"), ("failed", "canceled")


def next_state(state: Column, event: Column) -> Column:
    """The state after an event; an event whose guard fails changes nothing."""
    out = state
    for name, (guard, to) in TRANSITIONS.items():
        out = F.when((event == name) & (state.isin(*guard) if guard else F.lit(True)), to).otherwise(out)
    return out


def fold_states(events: DataFrame, key: str = "job_id") -> DataFrame:
    """key, status, error_message, applied (events that took effect), n_events: each job's state after its events.

    events: key, ts, seq, event, error_message. Jobs start as pending. The order is ts, then seq.
    """
    ordered = F.sort_array(F.collect_list(F.struct("ts", "seq", "event", F.coalesce("error_message", F.lit("")).alias("error"))))
    start = F.struct(F.lit("pending").alias("status"), F.lit("").alias("error_message"), F.lit(0).cast("long").alias("applied"))

    def step(s: Column, e: Column) -> Column:
        guard = F.lit(False)
        for name, (states, _) in TRANSITIONS.items():
            guard = F.when(e["event"] == name, s["status"].isin(*states) if states else F.lit(True)).otherwise(guard)
        error = F.when(guard & (e["event"] == "fail"), e["error"]).otherwise(s["error_message"])
        return F.struct(next_state(s["status"], e["event"]).alias("status"), error.alias("error_message"), (s["applied"] + guard.cast("long")).alias("applied"))

    folded = events.groupBy(key).agg(F.aggregate(ordered, start, step).alias("s"), F.count("*").alias("n_events"))
    return folded.select(key, "s.status", "s.error_message", "s.applied", "n_events")


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("id") == job_id).withColumn("error_message", F.coalesce("error_message", F.lit("")))


def bundle(bundles: DataFrame, job_id: str) -> DataFrame:
    return bundles.filter(F.col("job_id") == job_id)


def user(users: DataFrame, user_id: str) -> DataFrame:
    return users.filter(F.col("id") == user_id)


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    """Upper and lower case differ."""
    return users.filter(F.col("email") == email)


def user_jobs(jobs: DataFrame, user_id: str | None = None) -> DataFrame:
    """A user's jobs (or each user's), the latest first; ids break ties. place: the position in the list."""
    rows = jobs if user_id is None else jobs.filter(F.col("user_id") == user_id)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")).cast("long"))


def latest_retry(jobs: DataFrame) -> DataFrame:
    """retry_of, id, created_at of the latest retry of each job; ids break ties."""
    latest = F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("latest")
    return jobs.filter("retry_of IS NOT NULL").groupBy("retry_of").agg(latest).select("retry_of", "latest.id", "latest.created_at")


def canceled(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'canceled'").select("id")


def created(uploads: DataFrame, now: Column) -> DataFrame:
    """The first, pending job of each upload (id, user_id, original_name, format, object_key): attempt 1, no retry of any."""
    return uploads.select(
        F.col("id").cast("string").alias("id"), "user_id", "original_name", "format", "object_key", F.lit("pending").alias("status"), F.lit("").alias("error_message"),
        F.lit(None).cast("string").alias("retry_of"), F.lit(1).alias("attempt"), now.alias("created_at"), now.alias("updated_at"),
    )


def new_users(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted (id, email, ...) the users that can be added: no user has the email yet, and the first by id if several
    want it. Emails are compared as they are.
    """
    first = Window.partitionBy("email").orderBy("id")
    return wanted.join(users.select("email"), "email", "left_anti").withColumn("place", F.row_number().over(first)).filter("place = 1").select(wanted.columns)


def new_retries(jobs: DataFrame, now: Column) -> DataFrame:
    """A pending job, attempt one higher, for each failed or canceled one that has no retry yet."""
    able = jobs.filter(F.col("status").isin(*RETRYABLE))
    have = jobs.filter("retry_of IS NOT NULL").select(F.col("retry_of").alias("id")).distinct()
    return able.join(have, "id", "left_anti").select(
        F.concat(F.col("id").cast("string"), F.lit("-r")).alias("id"), "user_id", "format", F.lit("pending").alias("status"), F.lit("").alias("error_message"),
        F.col("id").alias("retry_of"), (F.greatest("attempt", F.lit(1)) + 1).alias("attempt"), now.alias("created_at"), now.alias("updated_at"),
    )


def registered(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """The bundles of completed jobs with a publishable report: job_id, path, validation, warnings (never null)."""
    done = jobs.filter("status = 'completed'").select(F.col("id").alias("job_id"), "user_id")
    none = F.array().cast("array<string>")
    return done.join(reports.filter("level <> 'invalid'"), "job_id").select("job_id", F.concat_ws("/", F.lit("bundles"), "user_id", "job_id").alias("path"), F.col("level").alias("validation"), F.coalesce("warnings", none).alias("warnings"))


def messages(jobs: DataFrame) -> DataFrame:
    """The queue's JSON message for each job."""
    return jobs.select(F.to_json(F.struct(F.col("id").alias("job_id"), "user_id", "format", "object_key", "attempt")).alias("value"))


def decoded(raw: DataFrame, value: str = "value") -> DataFrame:
    """raw with msg (struct, null if the value is no message) and dead (whether it goes to the dead letters)."""
    msg = F.from_json(value, "job_id string, user_id string, format string, object_key string, attempt int", {"mode": "PERMISSIVE"})
    out = raw.withColumn("msg", msg)
    return out.withColumn("dead", F.col("msg").isNull() | F.col("msg.job_id").isNull())


def claimed(messages_: DataFrame) -> DataFrame:
    """One message a job: the first by offset; repeated deliveries are dropped."""
    first = Window.partitionBy("job_id").orderBy("offset")
    return messages_.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
