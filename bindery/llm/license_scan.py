"""Operator 3, license scans by diagonal voting; DataFrame functions only.

Every rolling 3-gram of a document's words is hashed and joined with the template grams (a fixed, small table, so it is
broadcast). A match at word p of the document and word t of a template votes for the diagonal p - t. Neighbouring
diagonals are merged, so that a few inserted or lost words don't split a span, and spans are verified word by word:
votes count only where the words themselves are equal, and a span must cover enough of its template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.llm.common import LOWER, UPPER

K, DRIFT = 3, 3
#: A template of so many grams needs this share of them; a shorter one, whose every word tells, needs all.
LONG, SHARE = 10, 0.6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Label, whether it is a base phrase, words. A base phrase counts only whole.
TEMPLATES = (
    ("mit", True, "under the mit license"),
    ("apache-2", True, "apache license version 2"),
    ("cc-by-nc", True, "cc by nc"),
    ("gpl-3", False, "gnu general public license version 3"),
    ("gpl-2", False, "gnu general public license version 2"),
    ("lgpl", False, "gnu lesser general public license version"),
    ("agpl-3", False, "gnu affero general public license version 3"),
    ("mpl-2", False, "mozilla public license version 2 0"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mit-terms", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2-notice", False, "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by", False, "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", False, "creative commons attribution sharealike 4 0 international license"),
    ("public-domain", False, "released into the public domain"),
)


def gram_rows() -> list[tuple[int, str, bool, int, int, list[str]]]:
    """template, label, base, its number of grams, place of the gram, the gram's words."""
    return [(t, label, base, len(w) - K + 1, p, w[p : p + K]) for t, (label, base, text) in enumerate(TEMPLATES) for w in [text.split()] for p in range(len(w) - K + 1)]


def gram_table(spark: SparkSession) -> DataFrame:
    """The template grams, and a row with template -1 that each document's own marker meets."""
    rows = [*gram_rows(), (-1, "", False, 1, 0, [])]
    cells = [F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(n).alias("n_grams"), F.lit(p).alias("t"), F.array(*map(F.lit, w)).cast("array<string>").alias("gram"), (F.xxhash64(*map(F.lit, w)) if w else F.lit(0).cast("long")).alias("hash")) for t, label, base, n, p, w in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*cells)))


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, uid, n_words, template, label, base, n_grams, diagonal, t: a row per match, and one with template -1 per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("uid"), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words"))
    words = words.withColumn("n_words", F.size("words"))
    none = F.array().cast("array<array<string>>")
    grams = F.when(F.col("n_words") >= K, F.transform(F.sequence(F.lit(1), F.col("n_words") - K + 1), lambda i: F.slice(F.col("words"), i, K))).otherwise(none)
    # each row carries its own gram only: with the text's words it would take time by the square of the text
    grams = words.select("doc_id", "uid", "n_words", F.posexplode(F.concat(F.array(F.array().cast("array<string>")), grams)).alias("place", "own"))
    grams = grams.withColumn("hash", F.when(F.col("place") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*[F.get("own", F.lit(j)) for j in range(K)])))
    met = grams.join(F.broadcast(gram_table(docs.sparkSession)), "hash")
    same = F.when(F.col("template") < 0, F.col("place") == 0).otherwise((F.col("place") > 0) & (F.col("own") == F.col("gram")))
    return met.filter(same).select("doc_id", "uid", F.col("n_words").cast("long").alias("n_words"), "template", "label", "base", "n_grams", (F.col("place") - 1 - F.col("t")).alias("diagonal"), "t")


def spans(voted: DataFrame) -> DataFrame:
    """The verified spans: doc_id, uid, n_words, label, base, start, stop, share; rows of template -1 stay, with label '' and
    the number of the document's rows as n_rows.
    """
    doc = ["doc_id", "uid", "n_words"]
    template = [*doc, "template", "label", "base", "n_grams"]
    # tasks sum equal votes first: however many rows repeat a document, or have no id and no text, few go to its task
    summed = voted.groupBy(*template, "diagonal", "t").agg(F.count("*").alias("n"))
    diagonals = summed.repartition("doc_id", "uid").groupBy(*template, "diagonal").agg(F.collect_set("t").alias("hits"), F.sum("n").alias("n_rows"))
    order = Window.partitionBy(*template).orderBy("diagonal")
    # a base phrase has a place for each diagonal: only others are merged
    apart = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT), F.lit(True))
    islands = diagonals.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(order))
    merged = islands.groupBy(*template, "island").agg(
        F.max("n_rows").alias("n_rows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("covered"),
        F.min(F.col("diagonal") + F.array_min("hits")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("hits") + K).alias("stop"),
    )
    share = F.col("covered") / F.col("n_grams")
    enough = F.when(F.col("n_grams") < LONG, share == 1).otherwise((share >= SHARE) & (F.col("stop") - F.col("start") <= 2 * (F.col("n_grams") + K)))
    return merged.withColumn("share", share).filter(enough).select(*doc, "label", "base", "start", "stop", "share", F.when(F.col("template") < 0, F.col("n_rows")).alias("n_rows"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; score is the largest share of a template that a verified span covers, 0
    without one. A null text is an empty one: no words, no labels. A null doc_id is kept. Rows that repeat doc_id and text
    (told by 64 bits of its hash) get equal rows. Other columns are ignored; an empty table gives no row.
    """
    found = spans(votes(docs))
    own = F.col("label") != ""
    base = F.when(F.col("base"), F.col("start"))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    scanned = found.groupBy("doc_id", "uid", "n_words").agg(
        F.max("n_rows").cast("int").alias("n_rows"),
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(own).alias("labels"),
        F.coalesce(F.max(F.when(own, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return scanned.withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("n_rows")))).drop("uid", "n_rows", "row")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    grams = ",\n  ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {p}, '{' '.join(w)}')" for t, label, base, n, p, w in gram_rows())
    return f"""
WITH gram(template, label, base, n_grams, t, words) AS (VALUES
  {grams}
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), place AS (
  SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS words FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS p FROM doc WHERE len(w) >= 3)
), vote AS (
  SELECT DISTINCT doc_id, template, label, base, n_grams, p - t AS diagonal, t FROM place JOIN gram USING (words)
), diagonals AS (
  SELECT doc_id, template, label, base, n_grams, diagonal, list(t) AS hits FROM vote GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN base OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {DRIFT} THEN 1 ELSE 0 END AS apart
  FROM diagonals WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)
), island AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM marked
), span AS (
  SELECT doc_id, label, base, n_grams, len(list_distinct(flatten(list(hits)))) / n_grams AS share,
         min(diagonal + list_min(hits)) AS start, max(diagonal + list_max(hits) + {K}) AS stop
  FROM island GROUP BY doc_id, template, label, base, n_grams, island
), kept AS (
  SELECT * FROM span WHERE CASE WHEN n_grams < {LONG} THEN share = 1 ELSE share >= {SHARE} AND stop - start <= 2 * (n_grams + {K}) END
), found AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM kept GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM doc LEFT JOIN found USING (doc_id)
"""
