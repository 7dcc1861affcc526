"""A training corpus from raw documents: quality, exact copies, near copies, mixture, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last give the columns of documents, with any further columns
that docs have, whatever their names. A stage decides for rows, not for ids: rows that share a doc_id, or have none, are
kept or left out each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.common import TABLES, discard, stored, unused
from bindery.llm.exact_dedup import deduplicated
from bindery.llm.jaccard_join import jaccard_components
from bindery.llm.mixing import Mixture, mix
from bindery.llm.quality import quality_scores
from bindery.llm.vector_packing import pack

#: Words and percent of the near-duplicate stage; the mixture repeats no document, since a stage's rows are documents.
NEAR_WORDS, NEAR_PERCENT = 5, 80
MIXTURE = Mixture(share=0.8, max_epochs=1)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column, whose name is given too, that tells rows apart: doc_id where every row has one of its own; else
    numbers, stored with the rows so that they stay the same in every use.
    """
    row = unused(docs.columns, "row")
    rows, given, different = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if rows == given == different:
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    return stored(docs.withColumn(row, F.monotonically_increasing_id())), row


def chosen(docs: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of docs whose number is in the column `kept_row` of kept, with the columns that docs had before."""
    return docs.join(kept, docs[row] == kept["kept_row"], "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts are scored as texts of no bytes. Equal texts have equal scores, so repeated rows stay or go
    together; different texts under one doc_id are decided for by themselves. An empty table stays empty.
    """
    docs, row = numbered(docs)
    scores = quality_scores(docs.select("doc_id", "text", row), spark.read.parquet(f"{sf_dir}/labels.parquet"), key=row)
    return chosen(docs, row, scores.filter("predicted = 1").select(F.col(row).alias("kept_row")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id; a null doc_id is the smallest.

    Null counts as empty, and one such row stays; of rows that repeat doc_id and text one stays. Different texts under one
    doc_id both stay. An empty table stays empty.
    """
    return deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of NEAR_PERCENT and more connect, the one with the smallest doc_id; a null one is the smallest.

    Of a group's rows with that doc_id one stays. Texts without words, null and empty ones link with nothing and stay.
    Different texts under one doc_id are linked or not like others. An empty table stays empty.
    """
    docs, row = numbered(docs)
    found = jaccard_components(docs.select(F.col(row).alias("doc_id"), "text"), words=NEAR_WORDS, percent=NEAR_PERCENT, count=False)
    ids = docs.select(F.col(row).alias("kept_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    first = F.min(F.struct("id", "kept_row"))["kept_row"].alias("kept_row")
    return chosen(docs, row, found.select(F.col("doc_id").alias("kept_row"), "component_id").join(ids, "kept_row").groupBy("component_id").agg(first).select("kept_row"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes for its weights.

    A row is taken or left by its number, so repeated rows and different texts under one doc_id are rows like others. Null
    and empty texts have no token and stay with their leaf's whole epochs; null languages and sources are leaves of their
    own. An empty table stays empty.
    """
    docs, row = numbered(docs)
    taken = mix(docs.select(F.col(row).alias("doc_id"), "text", "lang", "source"), MIXTURE)
    return chosen(docs, row, taken.select(F.col("doc_id").alias("kept_row")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences; every row of docs gives one or more.

    Null and empty texts are documents of one token, the final id. Repeated rows and null doc_ids are packed like others,
    and an empty table gives no piece. Here alone the columns are not those of documents.
    """
    return pack(docs)


STAGES = [("quality", quality), ("exact copies", exact_copies), ("near copies", near_copies), ("mixture", mixture), ("packing", packing)]

#: The classifier can't be expressed in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself, and what it read, is removed once its own rows are written."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(TABLES)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            discard(spark, TABLES[done:-1])
    return docs
