"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm import hard_negatives, importance_resampling
from bindery.llm import license_scan as licenses
from bindery.llm import mixing
from bindery.llm.common import LOWER, UPPER
from bindery.llm.exact_dedup import exact_dedup
from bindery.llm.jaccard_join import jaccard_components
from bindery.llm.line_hashing import line_dedup
from bindery.llm.quality import quality_scores
from bindery.llm.sharding import sharded
from bindery.llm.spot_signatures import COMMON, fingerprints, matched
from bindery.llm.substring_dedup import substring_dedup
from bindery.llm.token_output import packed_ids
from bindery.llm.toxicity import toxicity_scores
from bindery.llm.vector_packing import pack, pack_conversations


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 by lines alone: the words and spans that go, and a digest of what stays."""
    found = line_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_removed", spans.alias("removed"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over conversations, where the limit on loss-bearing tokens binds."""
    return pack_conversations(table(spark, sf_dir, "conversations"))


def alike_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10's matching: all documents whose signature sets are alike."""
    return matched(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_classifier, op3_license_scan, op4_source_mixing, op5_packing, op6_ngram_jaccard_join, op7_exact_dedup, op8_toxicity, op9_token_output, op10_document_fingerprints, op11_importance_resampling, op12_sharding, op13_hard_negatives, repeated_lines, instruction_packing, alike_documents)}


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


OP6_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM doc)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM doc LEFT JOIN size USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a) USING (doc_id)
"""


LINES_SQL = rf"""
WITH doc AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), line AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS n FROM doc
), worded AS (
  SELECT doc_id, i, line || CASE WHEN i < n THEN chr(10) ELSE '' END AS line, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM line
), ranked AS (
  SELECT doc_id, i, line, len(w) AS words, len(w) >= 4 AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS later, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM worded
)
SELECT doc_id, CAST(coalesce(sum(words) FILTER (later), 0) AS BIGINT) AS n_removed, coalesce(string_agg((stop - length(line)) || '-' || stop, ',' ORDER BY i) FILTER (later), '') AS removed,
       md5(string_agg(CASE WHEN later THEN '' ELSE line END, '' ORDER BY i)) AS text_md5 FROM ranked GROUP BY doc_id
"""


COMMON_SQL = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))
ALIKE_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc
), marked AS (
  SELECT doc_id, i, word, common, common AND NOT bool_and(common) OVER (PARTITION BY doc_id) AS passed FROM (SELECT *, word IN ({COMMON_SQL}) AS common FROM word)
), counted AS (
  SELECT *, count(*) FILTER (NOT passed) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM marked
), content AS (
  SELECT doc_id, list(word ORDER BY i) AS c FROM marked WHERE NOT passed GROUP BY doc_id
), anchored AS (
  SELECT doc_id, word, before, common AND before < len(c) AS able, passed, c, bool_or(common AND before < len(c)) OVER (PARTITION BY doc_id) AS any_able FROM counted JOIN content USING (doc_id)
), signature AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, concat_ws(chr(1), word, c[before + 1], c[before + 2]) AS s FROM anchored WHERE able
    UNION ALL SELECT doc_id, concat_ws(chr(1), word, word, c[before + 1]) FROM anchored WHERE NOT any_able AND NOT passed
    UNION ALL SELECT doc_id, chr(2) || text FROM doc WHERE len(w) = 0 AND text <> '')
), size AS (
  SELECT doc_id, count(*) AS n FROM signature GROUP BY doc_id
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM signature x JOIN signature y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT doc_id, coalesce(n, 0) AS n_signatures, component_id, coalesce(n_links, 0) AS n_links FROM doc LEFT JOIN size USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"repeated_lines": LINES_SQL, "alike_documents": ALIKE_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op3_license_scan": licenses.oracle(), "op4_source_mixing": mixing.oracle(), "op7_exact_dedup": OP7_SQL, "op11_importance_resampling": importance_resampling.oracle(), "op13_hard_negatives": hard_negatives.oracle()}
