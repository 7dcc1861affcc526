"""Operator 11, resampling towards a target distribution by importance weights over hashed n-grams.

Words are numbered by a dictionary, n-grams are tuples of those numbers, and only the distinct tuples' bytes are put
together and hashed; the buckets are joined back to the places of each tuple and stored, two bytes a feature, so that
texts are read once; counts and weights come from there. A dictionary holds for CHUNK bytes of a task's texts: one for the
whole corpus would send every word to another task and back, where here what leaves a task is a count for each bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import numbered, release, stored
from bindery.llm.words import MARKS, word_bounds

#: Bytes of texts that share a dictionary of words.
CHUNK = 4_000_000
HASHES = 4294967296


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """The batches' rows in slices of about CHUNK bytes of text, lower-cased in A-Z; a null text is empty."""
    for batch in batches:
        texts, size, start = [], 0, 0
        for k, text in enumerate(batch.column(column)):
            raw = (text.as_py() or b"").lower()
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK or k + 1 == batch.num_rows:
                yield batch.slice(start, k + 1 - start), texts
                texts, size, start = [], 0, k + 1


class Grams:
    """The n-grams of some texts, one after the other: `words`, and for each n the first word's place and the tuple there."""

    def __init__(self, texts: list[bytes], longest: int) -> None:
        blob = b" ".join(texts)
        lengths = np.array([len(t) + 1 for t in texts])
        raw, start, end = word_bounds(blob, MARKS)
        #: where each text's words begin, and the end of all
        self.bounds = np.searchsorted(start, np.append(0, np.cumsum(lengths)))
        self.words = np.diff(self.bounds)
        inside = raw[~MARKS[raw]]
        offsets = np.append(0, np.cumsum(end - start)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(inside)]).dictionary_encode()
        #: word numbers, and the word of each number
        ids, self.vocabulary = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()
        of = np.repeat(np.arange(len(texts)), self.words)
        #: for each n: places, tuple numbers at those places, and the tuples as (number of the shorter tuple, word)
        self.places, self.tuples = [np.arange(len(ids))], [ids]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(2, longest + 1):
            at = self.places[-1]
            going = at + n - 1 < len(ids)
            going[going] = of[at[going]] == of[at[going] + n - 1]
            at = at[going]
            pairs = pa.array(self.tuples[-1][going] * max(1, len(self.vocabulary)) + ids[at + n - 1]).dictionary_encode()
            distinct = pairs.dictionary.to_numpy(zero_copy_only=False)
            self.parts.append(np.divmod(distinct, max(1, len(self.vocabulary))))
            self.places.append(at)
            self.tuples.append(pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64))

    def buckets(self, n_buckets: int) -> Iterator[np.ndarray]:
        """For each n the bucket of each distinct tuple: its words, joined by a space, hashed once."""
        grams = self.vocabulary
        yield np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % n_buckets
        for shorter, word in self.parts:
            grams = [grams[a] + b" " + self.vocabulary[b] for a, b in zip(shorter.tolist(), word.tolist(), strict=True)]
            yield np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % n_buckets


def small(n_buckets: int) -> np.dtype:
    """The type that buckets are stored as."""
    return np.dtype("<u2" if n_buckets <= 1 << 16 else "<u4")


def hashed(longest: int, n_buckets: int):
    """For mapInArrow over (doc_id, text): doc_id, n_words, buckets (those of all features, repeats too, as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, 1):
            grams = Grams(texts, longest)
            counts = [np.diff(np.searchsorted(places, grams.bounds)) for places in grams.places]
            begin = np.append(0, np.cumsum(sum(counts)))
            out, at = np.zeros(begin[-1], small(n_buckets)), begin[:-1].copy()
            for bucket, tuples, n in zip(grams.buckets(n_buckets), grams.tuples, counts, strict=True):
                out[np.arange(len(tuples)) + np.repeat(at - np.cumsum(n) + n, n)] = bucket[tuples]
                at += n
            offsets = (begin * out.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(grams.words.astype(np.int64)), packed], ["doc_id", "n_words", "buckets"])
        release()

    return run


def values(packed: pa.Array, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a column of packed ones, and where each row's begin, with the end."""
    kind = small(n_buckets)
    edges = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // kind.itemsize
    return np.frombuffer(packed.buffers()[2] or b"", kind)[edges[0] : edges[-1]].astype(np.int64), edges - edges[0]


def count(n_buckets: int):
    """For mapInArrow over (buckets): bucket, n, a task's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            total += np.bincount(values(batch.column(0), n_buckets)[0], minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return run


def weigh(gains: np.ndarray):
    """For mapInArrow over (doc_id, n_words, buckets): doc_id, n_words, n_features, weight (the floored mean of the gains)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, edges = values(batch.column(2), len(gains))
            features = np.diff(edges).astype(np.int64)
            weight = np.diff(np.append(0, np.cumsum(gains[buckets]))[edges]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def features(texts: DataFrame, longest: int, n_buckets: int) -> DataFrame:
    """doc_id, n_words, buckets of every row's text."""
    raw = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return raw.mapInArrow(hashed(longest, n_buckets), "doc_id long, n_words long, buckets binary")


def bucket_counts(found: DataFrame, n_buckets: int) -> np.ndarray:
    """How many features fall in each bucket: at most n_buckets numbers reach the driver."""
    out = np.zeros(n_buckets, np.int64)
    for bucket, n in found.select("buckets").mapInArrow(count(n_buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def resampled(docs: DataFrame, target: DataFrame, longest: int = 2, n_buckets: int = 10000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank (null for those not drawn), all long.

    Features are the runs of 1 to `longest` words of a text (lower-cased in A-Z; digits, letters and all beyond ASCII make
    words), counted with repeats in n_buckets buckets of their crc32. A bucket's gain is 1000 times the logarithm of its
    share among the target's features by that among docs', each count one higher, floored; a document's weight is the
    floored mean of its features' gains, its score the weight plus Gumbel noise of its doc_id and the seed. Of the
    documents with at least least_words words, `percent` in a hundred are drawn, by score, then doc_id: rank 1, 2, 3...

    A null text, and one without words, has no feature and weighs 0. A null doc_id has the noise of an empty one and comes
    last among equal scores; rows that repeat a doc_id are rows of their own, in any order where their scores tie. Without
    target texts all gains come from docs alone; an empty table gives no row. Other columns are ignored.
    """
    found = stored(features(docs, longest, n_buckets))
    own, wanted = (bucket_counts(x, n_buckets) for x in (found, features(target.select(F.lit(0).alias("doc_id"), "text"), longest, n_buckets)))
    ratio = lambda s, t: (t + 1.0) * (float(own.sum()) + n_buckets) / ((s + 1.0) * (float(wanted.sum()) + n_buckets))
    gains = np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(own.tolist(), wanted.tolist(), strict=True)], np.int64)
    weighed = found.mapInArrow(weigh(gains), "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / HASHES)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    ranked = numbered(scored.filter(able), [], [F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))


def oracle(n_buckets: int = 10000, percent: int = 25, least_words: int = 20, seed: int = 7) -> str:
    """The same in DuckDB's SQL, for runs of one and two words; crc32 goes over a feature's half bytes, the lower one first."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH half AS (
  SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k::BIGINT, [0::BIGINT, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(16) r(k))
), word AS (
  SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
), feature AS (
  SELECT kind, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM word
), bucket AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(f) * 2), lambda i: (strpos('0123456789ABCDEF', hex(f)[xor(i, 1) + 1]) - 1)::BIGINT)), lambda c, b: xor(c >> 4, t[(xor(c, b) & 15) + 1])), 4294967295) % {n_buckets} AS b
  FROM (SELECT DISTINCT f FROM feature), half
), counted AS (
  SELECT kind, doc_id, b, count(*) AS n FROM feature JOIN bucket USING (f) GROUP BY ALL
), share AS (
  SELECT b, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM counted GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM share)::DOUBLE + {n_buckets}) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM share)::DOUBLE + {n_buckets})))) AS g FROM share
), weighed AS (
  SELECT doc_id, sum(n) AS n, floor(sum(n * g) / sum(n)) AS weight FROM counted JOIN gain USING (b) WHERE kind = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) >= {least_words} AS able, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / {HASHES})))) ::BIGINT AS score
  FROM word LEFT JOIN weighed USING (doc_id) WHERE kind = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM scored WHERE able) * {percent} // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END AS rank FROM placed
"""
