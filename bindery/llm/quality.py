"""Operator 2, quality classifier.

Random Fourier features approximate a Gaussian kernel over statistics of each whole text; each partition sums its part
of the normal equations, whose ridge solution scores every document; out-of-fold scores set an isotonic calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import cut, fold, sampled
from bindery.llm.regression import calibrated, fourier_basis, fourier_features, isotonic_knots, ridge

#: At most so many labelled rows are fitted, chosen by a hash of doc_id; the only bound here, all else covers every row.
FIT_ROWS = 200_000
FEATURES, WIDTH, ALPHA, SEED, FIT_PARTS = 192, 3.0, 0.3, 7, 8
FOLD = (4, 2)
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "high_byte", "space", "newline",
    "distinct_words", "top_word", "distinct_lines", "line_words", "marked_words", "repeats_next", "digit_words", "exclaim", "bar",
)


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(members)] = 1
    return out


CLASSES = np.stack([
    byte_class(bytes(range(65, 91))), byte_class(bytes(range(48, 58))), byte_class(b".,;:'\"-?()"), byte_class(b"#$%&*+/<=>@[\\]^_`{|}~"),
    byte_class(bytes(range(128, 256))), byte_class(b" \t"), byte_class(b"\n"), byte_class(b"!"), byte_class(b"|"),
])
MARKS = b"!#$%&*+/<=>@[]^_{|}~"


def statistics(text: str | None) -> list[float]:
    """NAMES of a whole text: counts over its bytes, words and lines. A null text is an empty one; all zero then."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(NAMES)
    share = CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words, lines = raw.lower().split(), raw.split(b"\n")
    n = max(1, len(words))
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    marked = sum(c for w, c in kinds.items() if w[-1] in MARKS)
    digits = sum(c for w, c in kinds.items() if 48 <= w[0] <= 57)
    again = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n, *share[:7], len(kinds) / n, max(kinds.values(), default=0) / n,
        len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), marked / n, again / n, digits / n, share[7], share[8],
    ]


def with_statistics(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, row_key (the column key, a long) and x, the statistics of its text, for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(-1)
            offsets = np.arange(0, len(x) + 1, len(NAMES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(offsets, pa.array(x))], ["doc_id", "row_key", "x"])

    row_key = (F.col(key) if key else F.lit(None)).cast("long").alias("row_key")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key).mapInArrow(rows, "doc_id long, row_key long, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


def fit(stats: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> dict:
    """The model: scaling over all rows of stats, two half models for calibration, one on all sampled labelled rows.

    A doc_id that labels has more than once counts with its largest label; null labels and null ids teach nothing.
    """
    d = len(NAMES)
    moments = stats.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    centre, scale = (np.array([moments[f"{f}{i}"] or 0.0 for i in range(d)]) for f in ("avg", "stddev_pop"))
    scale[scale == 0] = 1.0
    weights, phases = fourier_basis(d, FEATURES, WIDTH * np.sqrt(d) / 2, SEED)
    model = {"centre": centre, "scale": scale, "weights": weights, "phases": phases, "beta": np.zeros(FEATURES + 1), "knots": (np.array([]), np.array([]))}
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter((fold(F.col("doc_id"), FOLD[0]) != FOLD[1]) & F.col("y").isNotNull())
    taught = taught.groupBy("doc_id").agg(F.max("y").alias("y"))
    # every partition sends its equations to the driver, 0.6 MB: by number, not by key, so that there are never more of them
    train = cut(sampled(taught, F.col("doc_id"), taught.count(), fit_rows).join(stats, "doc_id").select("doc_id", "y", "x").repartition(FIT_PARTS))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for b in batches:
            z, y, half = features(model, matrix(b.column(2))), b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy() % 2
            for h in (0, 1):
                own = z[half == h]
                sums[h] += own.T @ np.hstack([own, y[half == h, None]])
        yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()]})

    parts = [np.frombuffer(r[0]).reshape(2, FEATURES + 1, FEATURES + 2) for r in train.mapInArrow(equations, "sums binary").collect()]  # FIT_PARTS rows
    half = sum(parts, np.zeros((2, FEATURES + 1, FEATURES + 2)))
    both = half.sum(0)
    if not both[-1, -2]:
        return model
    model["beta"] = ridge(both[:, :-1], both[:, -1], ALPHA)
    betas = [ridge(h[:, :-1], h[:, -1], ALPHA) for h in half[::-1]]  # each half is scored by the other's model

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, own = features(model, matrix(b.column(2))), b.column(0).to_numpy() % 2
            yield pa.RecordBatch.from_pydict({"bin": np.round(np.where(own == 0, z @ betas[0], z @ betas[1]).clip(-1, 2) * 2000).astype(np.int32), "y": b.column(1)})

    # at most 6001 rows, however many are labelled
    counts = np.array([[r["bin"], r["p"], r["n"]] for r in train.mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("bin").collect()])
    model["knots"] = isotonic_knots(counts[:, 0] / 2000, counts[:, 1], counts[:, 2])
    return model


def features(model: dict, x: np.ndarray) -> np.ndarray:
    z = ((x - model["centre"]) / model["scale"]).clip(-6, 6)
    return fourier_features(z, model["weights"], model["phases"])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS, key: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher is better), predicted (1 if score >= threshold), and
    the column `key` of docs, a number that tells rows with one doc_id apart, if it is named.

    Learns from labels.quality of rows whose crc32(doc_id) mod 4 is not 2. Null and empty texts are scored as texts of no
    bytes; a null doc_id is not held out. Repeated rows each get their (equal) score. With no labels every score is 0.5.
    Other columns of either table are ignored.
    """
    stats = cut(with_statistics(docs, key))
    model = fit(stats, labels, "quality", fit_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "row_key": b.column(1), "score": calibrated(features(model, matrix(b.column(2))) @ model["beta"], model["knots"])})

    scored = stats.mapInArrow(rows, "doc_id long, row_key long, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLD[0]) == FOLD[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col("row_key").alias(str(key))] * bool(key))
