"""Operator 8, toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score from the words it holds; the document's score is the
noisy-or of its sentences' scores, and only document labels train the weights. The same weights then say which sentences
offend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import cut, fold, sampled

#: At most so many labelled rows are fitted, chosen by a hash of doc_id, so their words bound the model. All else covers
#: every row and every word. A word feature is in the model if its count among marked documents is so many deviations high.
FIT_ROWS = 40_000
LEAST_Z, STEPS, RATE, SHRINK = 4.0, 300, 0.15, 5e-5
PREFIXES, CACHED = (3, 5, 7), 500_000
FOLD = (3, 1)
SCHEMA = "doc_id long, score double, n_sentences int, offending array<struct<start:int,end:int,score:double>>"

#: Bytes to words: letters, digits and all beyond ASCII stay; sentence ends become line feeds; the rest blanks.
WORDS = bytes(c if c > 127 or chr(c).isalnum() else 10 if chr(c) in ".!?\n" else 32 for c in range(256))


def sentences(raw: bytes) -> list[bytes]:
    """The text's sentences as lower-case words between blanks; joined by one byte they have the length of the text."""
    return raw.lower().translate(WORDS).split(b"\n")


def word_features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, which its inflected and compound forms share."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]


def word_counts(train: DataFrame) -> DataFrame:
    """word, pos, neg: in how many documents of either label each word feature is, summed in each partition first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[dict, dict] = ({}, {})

        def flush() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "pos": pa.array([counts[1].get(w, 0) for w in words], pa.int64()), "neg": pa.array([counts[0].get(w, 0) for w in words], pa.int64())})
            counts[0].clear(), counts[1].clear()
            return out

        for b in batches:
            for y, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = counts[y > 0]
                for w in {f for w in set(raw.lower().translate(WORDS).split()) for f in word_features(w)}:
                    own[w] = own.get(w, 0) + 1
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield flush()
        yield flush()

    return train.select("y", "raw").mapInArrow(rows, "word binary, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def bag(raw: bytes, vocabulary: dict[bytes, int], known: dict[bytes, tuple[int, ...]]) -> tuple[list[list[int]], list[int], int]:
    """The feature ids of each sentence that has any of the vocabulary, those sentences' places, and the number of sentences.

    known keeps the ids of words seen before.
    """
    split = sentences(raw)
    total = sum(1 for s in split if s and not s.isspace())
    hits = {}
    for w in set(raw.lower().translate(WORDS).split()):
        found = known.get(w)
        if found is None:
            if len(known) >= CACHED:
                known.clear()
            found = known[w] = tuple(vocabulary[f] for f in word_features(w) if f in vocabulary)
        if found:
            hits[w] = found
    ids, places = [], []
    for k, s in enumerate(split if hits else ()):
        if words := hits.keys() & s.split():
            ids.append(sorted({i for w in words for i in hits[w]}))
            places.append(k)
    return ids, places, total


def noisy_or(sentence_logits: np.ndarray, n_plain: float, bias: float) -> float:
    """1 - product of (1 - p) over sentences; n_plain of them have only the bias."""
    return float(-np.expm1(-(np.logaddexp(0, sentence_logits).sum() + n_plain * np.logaddexp(0, bias))))


def train_weights(ids: np.ndarray, sentence_of: np.ndarray, bag_of: np.ndarray, plain: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the bags' log loss under noisy-or, by full-batch Adam steps.

    ids and sentence_of: a word of a sentence each; bag_of: each sentence's bag; plain: each bag's sentences without words.
    """
    theta = np.append(np.zeros(size), -6.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(sentence_of, theta[ids], len(bag_of))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        log_none = -np.bincount(bag_of, np.logaddexp(0, z), len(y)) - plain * np.logaddexp(0, theta[-1])
        some = np.maximum(-np.expm1(log_none), 1e-12)
        pull = np.where(y > 0, -(1 - some) / some, 1.0)  # of each bag on its sentences' scores
        dz = pull[bag_of] * p
        g = np.append(np.bincount(ids, dz[sentence_of], size), dz.sum() + (pull * plain).sum() * p0) / len(y)
        g[:-1] += SHRINK * np.sign(theta[:-1])  # words that others make needless go to zero
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[dict[bytes, int], np.ndarray, float]:
    """vocabulary, weights and bias from labels.toxic of rows whose crc32(doc_id) mod 3 is not 1."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter((fold(F.col("doc_id"), FOLD[0]) != FOLD[1]) & F.col("y").isNotNull())
    taught = taught.groupBy("doc_id").agg(F.max("y").alias("y"))
    # the sample has about fit_rows rows of two numbers, so it goes to the texts rather than they to it
    train = docs.join(F.broadcast(sampled(taught, F.col("doc_id"), taught.count(), fit_rows)), "doc_id")
    # copies would count the same evidence again and again
    train = cut(train.groupBy(F.sha2("raw", 256).alias("sha")).agg(F.max("y").alias("y"), F.any_value("raw").alias("raw")).select("y", "raw"))
    n, pos = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < pos < n:
        return {}, np.zeros(0), float(np.log((pos + 0.5) / (n - pos + 0.5)))
    rate = pos / n
    expected = (F.col("pos") + F.col("neg")) * rate
    words = word_counts(train).withColumn("z", (F.col("pos") - expected - 0.5) / F.sqrt(expected * (1 - rate) + 0.25)).filter(F.col("z") > LEAST_Z)
    vocabulary = {bytes(r[0]): k for k, r in enumerate(words.orderBy(F.desc("z"), "word").select("word").collect())}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            found = [bag(raw, vocabulary, known) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": b.column(0), "total": pa.array([f[2] for f in found], pa.int32()), "ids": pa.array([[i for s in f[0] for i in s] for f in found], pa.list_(pa.int32())), "sizes": pa.array([[len(s) for s in f[0]] for f in found], pa.list_(pa.int32()))})

    # fit_rows rows at most, of a few words each
    got = train.mapInArrow(bags, "y int, total int, ids array<int>, sizes array<int>").toArrow()
    y, total = got["y"].to_numpy().astype(float), got["total"].to_numpy().astype(float)
    sizes, per_bag = (np.concatenate([np.asarray(x, int) for x in got["sizes"].to_pylist()]), np.array([len(x) for x in got["sizes"].to_pylist()]))
    ids = np.concatenate([np.asarray(x, int) for x in got["ids"].to_pylist()])
    weights, bias = train_weights(ids, np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(y)), per_bag), total - per_bag, y, max(1, len(vocabulary)))
    return vocabulary, weights, bias


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_sentences, offending (start and end in code points
    and score of each sentence that scores 0.5 or more).

    Null and empty texts have no sentence and score 0; a null doc_id is not held out; repeated rows each get their (equal)
    score. Without labels of both kinds every sentence has the labels' base rate. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    vocabulary, weights, bias = fit(docs, labels, fit_rows)

    def score(raw: bytes, known: dict[bytes, tuple[int, ...]]) -> tuple[float, int, list[dict]]:
        ids, places, total = bag(raw, vocabulary, known)
        z = np.array([bias + weights[i].sum() for i in ids])
        offending = []
        if len(z) and z.max() >= 0:
            ends = np.cumsum([len(s) + 1 for s in sentences(raw)])
            points = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))  # code points before each byte
            for k, x in zip(places, z, strict=True):
                if x >= 0:
                    start, end = (int(ends[k - 1]) if k else 0), int(ends[k]) - 1
                    offending.append({"start": int(points[start]), "end": int(points[end]), "score": float(1 / (1 + np.exp(-x)))})
        return noisy_or(z, total - len(z), bias), total, offending

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            got = [score(raw, known) for raw in b.column(1).to_pylist()]
            found = pa.array([g[2] for g in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32()), found], ["doc_id", "score", "n_sentences", "offending"])

    held = F.coalesce(fold(F.col("doc_id"), FOLD[0]) == FOLD[1], F.lit(False))
    return docs.mapInArrow(rows, SCHEMA).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")
