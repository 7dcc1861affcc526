"""Operator 1 by lines or paragraphs alone: repeated units are found by digests of their words, whatever stands between these.

A unit's digest meets its like in the whole corpus; the earliest occurrence by (doc_id, text hash, place) is kept, the others are
removed with their offsets in the original. Only digests and places travel, never lines. Counts and first places are summed by
task before the exchange, and digests that many rows have are broadcast, so a hot line's rows stay where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import LOWER, UPPER, meet, stored
from bindery.llm.substring_dedup import LINE_WORDS, NULL_ID, SPANS

#: Bytes of a digest: two units of other words meet by chance once in 2^64 of 2^64 units.
DIGEST_BYTES = 16
#: Words of a line, and where units end, with what ends them: a line break, or line breaks with an empty line between.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ENDS = {"line": re.compile("\n"), "paragraph": re.compile(r"\n(?:[ \t\r]*\n)+")}
FOLDED = str.maketrans(UPPER, LOWER)
#: Units in a batch that a task gives.
BATCH = 50_000


def unit_spans(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Start and end of each unit in code points, what ends it included; together they are the text."""
    start = 0
    for m in ENDS[kind].finditer(text):
        yield start, m.end()
        start = m.end()
    if start < len(text):
        yield start, len(text)


def units(docs: DataFrame, kind: str, least: int) -> DataFrame:
    """doc, sha, start, end, words, digest of the units of `least` words or more of docs (doc, sha, text)."""
    types = {"doc": pa.int64(), "sha": pa.int64(), "start": pa.int32(), "end": pa.int32(), "words": pa.int32(), "digest": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(types.values())], list(types))
            held.clear()
            return out

        for b in batches:
            for doc, sha, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for start, end in unit_spans(text, kind):
                    words = WORD.findall(text[start:end].translate(FOLDED))
                    if len(words) >= least:
                        held.append((doc, sha, start, end, len(words), blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=DIGEST_BYTES).digest()))
                        if len(held) >= BATCH:
                            yield flush()
        yield flush()

    return docs.select("doc", "sha", "text").mapInArrow(read, "doc long, sha long, start int, end int, words int, digest binary")


def line_dedup(docs: DataFrame, kind: str = "line", least: int = LINE_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, text (what stays), n_removed (words), removed (spans of the original, in code points).

    Removed are units, lines or paragraphs by `kind`, of `least` words or more that stand earlier, in the same document too; with
    1 every unit that has a word. Units are equal when their words are, in lower case A-Z, in order. Occurrences rank by doc_id
    (null first), text hash, place. Rows that repeat doc_id and text are one document: each keeps what it keeps. Null and empty
    texts, and texts without words, stay as they are. Other columns are ignored; an empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("original"))
    keyed = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("sha", F.xxhash64(F.coalesce("original", F.lit(""))))
    found = stored(units(keyed.filter("original <> ''").withColumnRenamed("original", "text"), kind, least))

    place = F.struct("doc", "sha", "start")
    facts = stored(found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first <> last"))
    later = meet(found, facts, "digest", "n", found.count()).filter(place != F.col("first"))
    spans = F.sort_array(F.collect_set(F.struct("start", "end", "words"))).alias("later")
    gone = later.groupBy("doc", "sha").agg(spans)

    # what stays lies between what goes: from each removed span's end to the next one's start
    ends = F.concat(F.array(F.lit(0)), F.col("later.end"))
    starts = F.concat(F.col("later.start"), F.array(F.lit(1 << 30)))
    left = F.array_join(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda s: F.substring(F.col("original"), s["a"] + 1, s["b"] - s["a"])), "")
    joined = keyed.join(gone, ["doc", "sha"], "left")
    text = F.when(F.col("later").isNull(), F.col("original")).otherwise(left)
    n = F.coalesce(F.aggregate("later", F.lit(0).cast("long"), lambda s, x: s + x["words"]), F.lit(0).cast("long"))
    removed = F.coalesce(F.transform("later", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), F.array().cast(SPANS))
    return joined.select("doc_id", text.alias("text"), n.alias("n_removed"), removed.alias("removed"))
