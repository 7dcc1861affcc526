"""The engine's tables as they are derived from the test tables, in Spark and, beside it, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.schema import FORMATS

STATUS = {"signup": "pending", "view": "processing", "purchase": "completed", "error": "failed", "click": "canceled"}
EVENT = {"signup": "claim", "click": "cancel", "purchase": "complete", "error": "fail", "view": "publish_error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column: str, names: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} END"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        n.cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("upload-"), n.cast("string")).alias("original_name"),
        F.get(F.array(*map(F.lit, FORMATS)), (n % 6).cast("int")).alias("format"), F.concat(F.lit("originals/"), n.cast("string")).alias("object_key"), mapped("event_type", STATUS).alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), "props")).otherwise("").alias("error_message"),
        F.when((n % 10 == 0) & (n >= 50), (F.floor(n / 50) * 50 - 1).cast("string")).alias("retry_of"), ((n % 3) + 1).cast("int").alias("attempt"),
        F.col("ts").alias("created_at"), F.expr("timestampadd(MICROSECOND, CAST(round(value * 1e6) AS BIGINT), ts)").alias("updated_at"),
    )


JOBS = f"""jobs AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, 'upload-' || event_id AS original_name, {list(FORMATS)}[event_id % 6 + 1] AS format, 'originals/' || event_id AS object_key,
         {case("event_type", STATUS)} AS status, CASE WHEN event_type = 'error' THEN 'error ' || props ELSE '' END AS error_message,
         CASE WHEN event_id % 10 = 0 AND event_id >= 50 THEN CAST(event_id // 50 * 50 - 1 AS VARCHAR) END AS retry_of, CAST(event_id % 3 + 1 AS INTEGER) AS attempt,
         ts AS created_at, ts + to_microseconds(CAST(round(value * 1e6) AS BIGINT)) AS updated_at
  FROM events
)"""


def bundles(jobs_: DataFrame) -> DataFrame:
    level = F.when(F.col("id").cast("long") % 3 == 0, "valid_with_warnings").otherwise("valid")
    return jobs_.filter("status = 'completed'").select(F.col("id").alias("job_id"), level.alias("validation"))


BUNDLES = "bundles AS (SELECT id AS job_id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'valid_with_warnings' ELSE 'valid' END AS validation FROM jobs WHERE status = 'completed')"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 1000).cast("string"))
    return table(spark, sf_dir, "events").select(key.alias("job_id"), F.col("event_id").alias("seq"), "ts", mapped("event_type", EVENT).alias("event"), F.col("props").alias("error_message"))


JOB_EVENTS = f"job_events AS (SELECT user_id || '-' || event_id // 1000 AS job_id, event_id AS seq, ts, {case('event_type', EVENT)} AS event, props AS error_message FROM events)"


def chat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document for each conversation: a heading and a text for each turn."""
    turn = F.concat(F.lit("# "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", turn.alias("part")))), lambda t: t["part"])
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(turns, "\n\n").alias("text"))


CHATS = "chats AS (SELECT conv_id AS doc_id, string_agg('# ' || role || ' ' || turn || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


def chat_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, path, content of a bundle for each conversation, with faults that its numbers decide."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "role", F.coalesce("text", F.lit("")).alias("text"))
    job = F.col("c").cast("string").alias("job_id")
    name = F.format_string("fragmento-%02d.md", F.col("t") + 1)
    plain = (F.col("c") % 5 == 0) & (F.col("t") == 1)
    body = F.when((F.col("c") % 17 == 0) & (F.col("t") == 2), "").when(plain, F.col("text")).otherwise(F.concat(F.lit("# "), "role", F.lit("\n\n"), "text"))
    image = F.when((F.col("c") % 3 == 0) & (F.col("t") == 0), "\n\n![i](../assets/x.png)").otherwise("")
    concepts = t.select(job, F.concat(F.lit("conceptos/"), name).alias("path"), F.concat(body, image).alias("content"))
    row = F.when((F.col("c") + F.col("t")) % 7 != 0, F.concat(F.lit("["), name, F.lit("](conceptos/"), name, F.lit(")\n"))).otherwise("")
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", row.alias("r")))), lambda x: x["r"]), "")
    broken = F.when(F.col("c") % 11 == 0, "[no](conceptos/none.md)\n").otherwise("")
    index = t.groupBy("c").agg(rows.alias("rows")).select(job, F.lit("index.md").alias("path"), F.concat("rows", broken, F.lit("[web](https://example.com)\n")).alias("content"))
    one = t.select("c").distinct()
    log = one.filter("c % 13 <> 0").select(job, F.lit("log.md").alias("path"), F.concat(F.lit("SHA-256 Conceptos generados"), F.when(F.col("c") % 4 != 0, " Formato").otherwise("")).alias("content"))
    asset = one.filter("c % 6 = 0").select(job, F.lit("assets/x.png").alias("path"), F.lit("png").alias("content"))
    return concepts.unionByName(index).unionByName(log).unionByName(asset)


FILES = r"""t AS (SELECT conv_id AS c, turn AS t, role, coalesce(text, '') AS text, printf('fragmento-%02d.md', turn + 1) AS name FROM conversations),
files AS (
  SELECT CAST(c AS VARCHAR) AS job_id, 'conceptos/' || name AS path, CASE WHEN c % 17 = 0 AND t = 2 THEN '' WHEN c % 5 = 0 AND t = 1 THEN text ELSE '# ' || role || chr(10) || chr(10) || text END
         || CASE WHEN c % 3 = 0 AND t = 0 THEN chr(10) || chr(10) || '![i](../assets/x.png)' ELSE '' END AS content FROM t
  UNION ALL SELECT CAST(c AS VARCHAR), 'index.md', string_agg(CASE WHEN (c + t) % 7 <> 0 THEN '[' || name || '](conceptos/' || name || ')' || chr(10) ELSE '' END, '' ORDER BY t)
         || CASE WHEN c % 11 = 0 THEN '[no](conceptos/none.md)' || chr(10) ELSE '' END || '[web](https://example.com)' || chr(10) FROM t GROUP BY c
  UNION ALL SELECT DISTINCT CAST(c AS VARCHAR), 'log.md', 'SHA-256 Conceptos generados' || CASE WHEN c % 4 <> 0 THEN ' Formato' ELSE '' END FROM t WHERE c % 13 <> 0
  UNION ALL SELECT DISTINCT CAST(c AS VARCHAR), 'assets/x.png', 'png' FROM t WHERE c % 6 = 0
)"""


def document_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a document whose assets are its texts; a language's texts share a file name."""
    src = F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit("/Foto "), "lang", F.lit(".PNG"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), src.alias("src"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


DOC_ASSETS = "assets AS (SELECT source AS doc_id, doc_id AS ord, 'img/' || doc_id || '/Foto ' || lang || '.PNG' AS src, sha1(coalesce(text, '')) AS sha1 FROM documents)"


def pdf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as positioned texts: fifty orders to a document, ten to a page, some side by side."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(order / 50).cast("string").alias("doc_id"), (F.floor(order % 50 / 10) + 1).cast("int").alias("page"), (order * 10 + line).cast("int").alias("ord"),
        ((order % 10) * 80 + F.floor((line + 1) / 2) * 12 + F.when(line % 4 == 0, 0.5).otherwise(0.0)).alias("top"),
        (F.when(line % 2 == 1, 40.0).otherwise(300.0) + F.col("l_tax") * 10).alias("left"), F.lit(120.0).alias("width"),
        F.when((line == 1) & (order % 7 == 0), 20.0).otherwise(11.0).alias("size"),
        F.concat(order.cast("string"), F.lit(". "), F.when(F.col("l_returnflag") == "N", "neu-").otherwise("Alt"), F.lit(" "), F.col("l_linestatus")).alias("text"),
    )


def font_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as lines of a document for every hundred orders, sized by quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).cast("string").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("idx"),
        F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("size"), F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus")).alias("text"),
    )


FONT_LINES = "lines AS (SELECT CAST(l_orderkey // 100 AS VARCHAR) AS doc_id, CAST(l_orderkey * 10 + l_linenumber AS INTEGER) AS idx, l_linenumber AS page, l_quantity AS size, l_linenumber || '. ' || l_returnflag || ' ' || l_linestatus AS text FROM lineitem)"
