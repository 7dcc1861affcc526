"""Metrics over jobs and bundles. A user filter is added only where a user is given, so Catalyst can push it down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.operators.bundles import PRODUCT


def of_user(jobs: DataFrame, user_id: str | None) -> DataFrame:
    return jobs if user_id is None else jobs.filter(F.col("user_id") == user_id)


def jobs_by(jobs: DataFrame, column: str, user_id: str | None = None) -> DataFrame:
    return of_user(jobs, user_id).groupBy(column).agg(F.count("*").alias("n"))


def jobs_by_both(jobs: DataFrame) -> DataFrame:
    """Counts by status and by format in one pass: kind, name, n."""
    both = jobs.groupingSets([["status"], ["format"]], "status", "format").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return both.select(F.when(F.col("g") == 1, "status").otherwise("format").alias("kind"), F.when(F.col("g") == 1, F.col("status")).otherwise(F.col("format")).alias("name"), "n")


def bundles_by_validation(jobs: DataFrame, bundles: DataFrame, user_id: str | None = None) -> DataFrame:
    return bundles.join(of_user(jobs, user_id).select(F.col("id").alias("job_id")), "job_id").groupBy("validation").agg(F.count("*").alias("n"))


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def average_duration(jobs: DataFrame, user_id: str | None = None) -> DataFrame:
    """Mean seconds from creation to the last change of completed and failed jobs; 0 if there is none."""
    ended = of_user(jobs, user_id).filter(F.col("status").isin("completed", "failed"))
    return ended.agg(F.coalesce(F.avg(seconds_between(F.col("created_at"), F.col("updated_at"))), F.lit(0.0)).alias("avg_seconds"))


def retries(jobs: DataFrame, user_id: str | None = None) -> DataFrame:
    return of_user(jobs, user_id).filter("retry_of IS NOT NULL").agg(F.count("*").alias("n"))


#: The exported families, after the product's name: name, help, type, label.
FAMILIES = (
    ("jobs_total", "Trabajos de conversión por estado.", "gauge", "status"),
    ("jobs_by_format_total", "Trabajos por formato de entrada.", "gauge", "format"),
    ("bundles_total", "Bundles publicados por clasificación de validación.", "gauge", "validation"),
    ("job_duration_seconds", "Duración media de las conversiones terminadas.", "gauge", ""),
    ("retries_total", "Trabajos creados como reintento de otro.", "counter", ""),
)


def totals(jobs: DataFrame) -> DataFrame:
    """avg_seconds and retries of all jobs, in one pass; one row for an empty table too."""
    ended = F.when(F.col("status").isin("completed", "failed"), seconds_between(F.col("created_at"), F.col("updated_at")))
    return jobs.agg(F.coalesce(F.avg(ended), F.lit(0.0)).alias("avg_seconds"), F.count("retry_of").alias("retries"))


def prometheus(jobs: DataFrame, bundles: DataFrame, product: str = PRODUCT) -> DataFrame:
    """family, label, line: the metrics as lines of text; families and labels give their order."""

    def counted(k: int, label: Column) -> Column:
        line = F.format_string(f'{product}_{FAMILIES[k][0]}{{{FAMILIES[k][3]}="%s"}} %d', label, F.col("n"))
        return F.struct(F.lit(k).alias("family"), label.alias("label"), line.alias("line"))

    def single(k: int, form: str, value: str) -> Column:
        return F.struct(F.lit(k).alias("family"), F.lit("").alias("label"), F.format_string(f"{product}_{FAMILIES[k][0]} {form}", value).alias("line"))

    both = jobs_by_both(jobs).select(F.when(F.col("kind") == "status", counted(0, F.col("name"))).otherwise(counted(1, F.col("name"))).alias("m"))
    levels = bundles_by_validation(jobs, bundles).select(counted(2, F.col("validation")).alias("m"))
    rest = totals(jobs).select(F.explode(F.array(single(3, "%.3f", "avg_seconds"), single(4, "%d", "retries"))).alias("m"))
    return both.unionByName(levels).unionByName(rest).select("m.*")


def prometheus_text(jobs: DataFrame, bundles: DataFrame, product: str = PRODUCT) -> DataFrame:
    """The whole export as one text: help and type lines before each family's values."""
    lines = prometheus(jobs, bundles, product).groupBy("family").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "line"))), lambda r: r["line"]), "\n").alias("body"))
    heads = F.element_at(F.array(*[F.lit(f"# HELP {product}_{n} {h}\n# TYPE {product}_{n} {t}\n") for n, h, t, _ in FAMILIES]), F.col("family") + 1)
    whole = lines.select("family", F.concat(heads, "body").alias("text"))
    return whole.agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("family", "text"))), lambda r: r["text"]), "\n"), F.lit("\n")).alias("text"))
