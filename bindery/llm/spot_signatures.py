"""Operator 10, document fingerprints by spot signatures.

Each common word is an anchor; the chain of content words that follows it, with the anchor, is a signature. A text's
signatures form a set, and likeness is the Jaccard of two sets. fingerprints() compares each document with its edited text
and its next one; matched() finds all documents that are alike, by length partitions and pruned Jaccard.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.jaccard_join import jaccard_components
from bindery.llm.words import MARKS, chain, word_hashes

CHAIN, RATIO = 2, 0.8

#: Common words of English, French, German and Spanish.
COMMON = """
a all an and are as at be been but by can did for from had has have he her his if in into is it its more no not of on one
or our out said she so than that the their them then there these they this to was we were what when which who will with you
au aux avec ce ces cette comme dans de des du elle en est et il ils la le les leur mais ne ou par pas plus pour que qui sa
se ses son sont sur un une am als auch auf aus bei das dass dem den der die durch ein eine einem einen einer es für hat im
ist mit nach nicht noch oder sich sie sind so um und von vor war wie wird zu zum zur al con como del el ella los las lo más
no o para pero por que se sin su sus una y ya
""".split()  # fmt: skip


def common_hashes() -> np.ndarray:
    return np.sort(np.unique(word_hashes(" ".join(sorted(set(COMMON))).encode(), MARKS)))


COMMON_HASHES = common_hashes()


def spots(raw: bytes) -> np.ndarray:
    """A text's sorted distinct signatures as 64-bit numbers, from its bytes in UTF-8.

    Anchors are the common words; in a text without any that a content word follows, every content word is one. Content
    words are the others; if there are none, all are. Without words the text itself is the signature; an empty text has none.
    """
    raw = raw.lower()
    h = word_hashes(raw, MARKS)
    if not len(h):
        return np.frombuffer(hashlib.sha256(raw).digest()[:8], "<u8") if raw else np.zeros(0, "<u8")
    common = COMMON_HASHES[np.minimum(np.searchsorted(COMMON_HASHES, h), len(COMMON_HASHES) - 1)] == h
    content = np.flatnonzero(~common)
    if not len(content):
        content = np.arange(len(h))
    anchors = np.flatnonzero(common)
    first = np.searchsorted(content, anchors, "right")
    anchors, first = anchors[first < len(content)], first[first < len(content)]
    if not len(anchors):
        anchors, first = content, np.arange(len(content))
    following = np.append(h[content], np.zeros(CHAIN, np.uint64))
    return np.unique(chain(h[anchors], *[following[first + i] for i in range(CHAIN)]))


def signatures(text: str) -> np.ndarray:
    """The text's sorted distinct signatures as 32-bit numbers."""
    return np.unique((spots(text.encode("utf-8", "surrogatepass")) >> np.uint64(32)).astype("<u4"))


def matched(docs: DataFrame, percent: int = 80, count: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_signatures, component_id (the smallest doc_id reachable by links, itself included),
    and, unless count is False, n_links. Two texts link when the Jaccard of their signature sets is percent or more.

    Sets are listed by length class, and a set meets those of its own and the neighbouring classes only; in a class they
    are compared through inverted lists, and sizes that can't reach the Jaccard aren't. Null and empty texts have no
    signature and link with nothing. Null doc_ids, repeated rows, other columns and empty tables are as in the n-gram join.
    """
    return jaccard_components(docs, percent=percent, count=count, elements=spots, by_length=True).withColumnRenamed("n_shingles", "n_signatures")


def sketch(sigs: np.ndarray) -> tuple[int, np.ndarray]:
    """The size of the set, and all its members."""
    return len(sigs), sigs


def fingerprint(s: tuple[int, np.ndarray]) -> str:
    """The set as text: size and members as little-endian 32-bit numbers in base 64. Equal texts have equal ones."""
    return base64.b64encode(np.append(np.array([s[0]], "<u4"), s[1]).astype("<u4").tobytes()).decode()


def from_fingerprint(text: str) -> tuple[int, np.ndarray]:
    x = np.frombuffer(base64.b64decode(text), "<u4")
    return int(x[0]), x[1:]


def length_partition(size: int, ratio: float = RATIO) -> int:
    """Sets whose sizes differ by more than the ratio are at least a partition apart, and further apart can't be alike."""
    return int(np.log(max(1, size)) / -np.log(ratio))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], floor: float = 0.0) -> float:
    """Jaccard of two sets, exact at every size.

    Two empty sets are alike (1); an empty one and another aren't (0). Below `floor`, where set, 0: sizes decide first.
    """
    small, large = sorted((a[0], b[0]))
    if large == 0:
        return 1.0
    if small == 0 or small / large < floor or (floor and length_partition(large, floor) - length_partition(small, floor) > 1):
        return 0.0
    both = len(np.intersect1d(a[1], b[1], assume_unique=True))
    j = both / (small + large - both)
    return j if j >= floor else 0.0


def split_points(ids: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending values that deal the rows of `ids` out evenly by key."""
    if n < 2:
        return []
    found = ids.agg(F.percentile_approx(key, [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0]
    return sorted(set(found or []))


def bucket_of(key: Column, splits: list[int]) -> Column:
    """How many of the ascending splits are at most key, by binary search."""
    if not splits:
        return F.lit(0)
    at = F.array(*[F.lit(s).cast("long") for s in splits])
    state = F.struct(F.lit(0).alias("low"), F.lit(len(splits)).alias("high"))

    def step(s: Column, _: Column) -> Column:
        mid = ((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(at, mid) <= key
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, mid).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(splits).bit_length())), state, step, lambda s: s["low"])


def with_followers(docs: DataFrame) -> DataFrame:
    """doc_id, text in runs of ascending doc_id, each run in one partition and followed by the first row of the next run
    (tail 1); the last run by the first row of all. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    splits = split_points(rows, "key", 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("run", bucket_of(F.col("key"), splits))
    first = {r[0]: r[1] for r in rows.groupBy("run").agg(F.min("key")).collect()}  # a row for each run
    if not first:
        return rows.select("run", F.lit(0).alias("tail"), "doc_id", "text")
    runs = sorted(first)
    before = {r: runs[k - 1] for k, r in enumerate(runs)}
    heads = F.array(*[F.lit(first.get(k)).cast("long") for k in range(runs[-1] + 1)])
    previous = F.array(*[F.lit(before.get(k)).cast("int") for k in range(runs[-1] + 1)])
    own = F.struct(F.col("run").alias("run"), F.lit(0).alias("tail"))
    copy = F.struct(F.get(previous, F.col("run")).alias("run"), F.lit(1).alias("tail"))
    places = F.when(F.get(heads, F.col("run")) == F.col("key"), F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "key", F.inline(places))
    return dealt.repartition("run").sortWithinPartitions("run", "tail", "key", "text").select("run", "tail", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures int, length_partition int"


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs, of SCHEMA: the fingerprint of each whole text, of its edited text (the last quarter of its
    code points, rounded down, replaced by the first as many of the next document's) and how alike they are.

    Null texts are empty. Rows go by ascending doc_id, null first, then by text; the last one's next is the first one, and
    a single row's next is itself. Repeated rows each get a row. Other columns are ignored; an empty table gives no row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # run, doc_id, text, signatures of the row that waits for its next
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal out
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for run, tail, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tail and (held is None or held[0] != run):
                    continue  # the next run's first doc_id is repeated; its first row has been taken
                own = sketch(signatures(text))
                if held is not None:
                    _, held_id, held_text, held_own = held
                    n = len(held_text)
                    edited = held_text[: n - n // 4] + text[: n // 4]
                    other = sketch(signatures(edited)) if n // 4 else held_own
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held_id, n, sha, fingerprint(held_own), fingerprint(other), likeness(held_own, other), likeness(held_own, own), held_own[0], length_partition(held_own[0])))
                held = None if tail else (run, doc_id, text, own)
                if len(out) >= 2000:
                    yield flush()
        yield flush()

    return with_followers(docs).mapInArrow(rows, SCHEMA)
