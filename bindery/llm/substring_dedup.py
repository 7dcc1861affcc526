"""Operator 1, substring dedup by unit hashing.

Texts are cut into units of a few words whose cuts depend on the words around them alone, so a passage is cut alike wherever
it stands; digests of the units with their neighbouring words meet in buckets, where the earliest occurrence by
(doc_id, place) is kept. Later ones are removed where they form runs of enough words, with their offsets in the original.
Shorter lines have a digest of their own: one that stands earlier elsewhere is removed whatever stands around it.

Digests travel as packed arrays, a few rows for each task and bucket; what is later travels packed to the documents' owners
as places in words, which a document's text turns into offsets again. A task sends only its own first occurrence of a
digest: its other ones can't be the earliest, however frequent the unit, so no bucket gathers a hot unit's occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import input_bytes
from bindery.llm.words import BLANKS, CHUNK, MARKS, mix, powers, word_bounds, word_hashes

#: A cut is at the word with the smallest hash of WINDOW words; a digest covers CONTEXT words more on both sides. Both end at
#: line ends, and where sentences of SENTENCE_WORDS or more meet. A removed run has RUN_WORDS;
#: a removed line LINE_WORDS at least, so that headings and the like stay.
WINDOW, CONTEXT, SENTENCE_WORDS, RUN_WORDS, LINE_WORDS = 5, 4, 4, 25, 4
#: Bytes of text for a bucket, and for an owner of documents; units that a task gathers before it sends them.
BUCKET_BYTES, OWNER_BYTES, FLUSH_UNITS = 8_000_000, 24_000_000, 400_000
NULL_ID = -(1 << 63)

#: Sentence ends without white space after them, and the ellipsis, as ASCII of the same length in bytes.
ENDS = (("。", b" . "), ("！", b" . "), ("？", b" . "), ("…", b"  ."))
#: place and words count words.
UNIT = np.dtype([("digest", "<u8"), ("doc", "<i8"), ("sha", "<u8"), ("place", "<i4"), ("words", "<i2")])


def cut_words(h: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Where units begin, in words: at each segment's first word, and at the smallest of any WINDOW words within one.

    Only the WINDOW - 1 words on both sides of a word and the segment's bounds decide whether it is a cut.
    """
    first = np.append(True, segment[1:] != segment[:-1])
    if (n := len(h) - WINDOW + 1) > 0:
        best, at = h[:n].copy(), np.arange(n)
        for k in range(1, WINDOW):
            lower = h[k : n + k] <= best
            best[lower] = h[k : n + k][lower]
            at[lower] = np.flatnonzero(lower) + k
        first[at[segment[:n] == segment[WINDOW - 1 :]]] = True
    return np.flatnonzero(first)


def word_spans(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes with ENDS in ASCII, the start and end of each word in them, and where its token starts and ends in
    code points: the marks that touch a word go with it.
    """
    original = text.encode("utf-8", "surrogatepass").lower()
    raw = original
    for mark, ascii_mark in ENDS:
        raw = raw.replace(mark.encode(), ascii_mark)
    _, start, end = word_bounds(raw, MARKS)
    a = np.frombuffer(original, np.uint8)
    blank = np.flatnonzero(BLANKS[a])
    stop = np.minimum(np.append(blank, len(a))[np.searchsorted(blank, end)], np.append(start[1:], len(a))[: len(end)])
    begin = np.maximum(np.append(-1, blank)[np.searchsorted(blank, start)] + 1, np.append(0, stop[:-1])[: len(start)])
    points = np.append(0, np.cumsum((a & 0xC0) != 0x80))
    return raw, start, end, points[begin], points[stop]


def unit_rows(raw: bytes, start: np.ndarray, line_words: int = 0) -> np.ndarray:
    """The units of word_spans' bytes and words as UNIT rows without doc and sha, in order.

    Lines of LINE_WORDS or more but fewer than `line_words` follow, their words counted negative.
    """
    if not len(start):
        return np.zeros(0, UNIT)
    a, h = np.frombuffer(raw, np.uint8), word_hashes(raw, MARKS)

    # segments: lines, cut where sentences meet, unless another sentence ends near by
    line = np.cumsum(a == 10)[start]
    ends = np.zeros(len(a), bool)
    ends[:-1] = ((a[:-1] == 33) | (a[:-1] == 46) | (a[:-1] == 63)) & ((a[1:] == 32) | (a[1:] == 9))
    sentence = np.cumsum(ends)[start]
    new_line = np.append(True, line[1:] != line[:-1])
    at = np.flatnonzero(new_line | np.append(True, sentence[1:] != sentence[:-1]))
    words = np.diff(np.append(at, len(h)))
    apart = new_line[at] | ((np.append(0, words[:-1]) >= SENTENCE_WORDS) & (words >= SENTENCE_WORDS))
    bounds = np.append(at[apart], len(h))
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    up, down = powers(max(CHUNK + 1, 1 << len(h).bit_length()))
    sums = np.append(np.uint64(0), np.cumsum(h * up[: len(h)]))

    def rows(first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), UNIT)
        # where the unit lies in those words counts too: they may be the same for two units of a short segment
        around = mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))
        out["digest"] = mix(around + ((first - low) << 32 | (last - first)).astype(np.uint64))
        out["place"], out["words"] = first, last - first
        return out

    first = cut_words(h, segment)
    last = np.append(first[1:], len(h))
    own = rows(first, last, np.maximum(first - CONTEXT, bounds[segment[first]]), np.minimum(last + CONTEXT, bounds[segment[first] + 1]))
    if not line_words:
        return own
    first = np.flatnonzero(new_line)
    last = np.append(first[1:], len(h))
    short = (last - first >= LINE_WORDS) & (last - first < line_words)
    lines = rows(first[short], last[short], first[short], last[short])
    lines["digest"] = mix(~lines["digest"])  # a line meets lines only
    lines["words"] *= -1
    return np.append(own, lines)


def units(text: str) -> Iterator[tuple[int, int, int, int]]:
    """digest, start, end (code points) and number of words of each unit, in order. Units without a word are left out."""
    raw, start, _, begins, stops = word_spans(text)
    for u in unit_rows(raw, start):
        yield int(u["digest"]), int(begins[u["place"]]), int(stops[u["place"] + u["words"] - 1]), int(u["words"])


def packed(x: np.ndarray, digests: bool) -> bytes:
    """Units that go by document: each document once with its number of units, then the units column by column."""
    edges = np.append(np.append(0, np.flatnonzero((x["doc"][1:] != x["doc"][:-1]) | (x["sha"][1:] != x["sha"][:-1])) + 1), len(x))
    docs = x[edges[:-1]]
    columns = [np.array([len(docs), len(x)], "<i4"), docs["doc"], docs["sha"], np.diff(edges).astype("<i4"), x["place"], x["words"]]
    return b"".join(c.tobytes() for c in (*columns, *([x["digest"]] if digests else [])))


def unpacked(blob: bytes) -> np.ndarray:
    (docs, n), at = np.frombuffer(blob, "<i4", 2).tolist(), 8

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, k, at)
        at += out.nbytes
        return out

    out = np.zeros(n, UNIT)
    doc, sha, count = take("<i8", docs), take("<u8", docs), take("<i4", docs)
    out["doc"], out["sha"], out["place"], out["words"] = np.repeat(doc, count), np.repeat(sha, count), take("<i4", n), take("<i2", n)
    if at < len(blob):
        out["digest"] = take("<u8", n)
    return out


def split_first(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest occurrence of each digest, and the later ones. Rows that repeat a document are the same occurrence."""
    if not len(x):
        return x, x
    x = x[np.lexsort((x["place"], x["sha"], x["doc"], x["digest"]))]
    new = np.append(True, x["digest"][1:] != x["digest"][:-1])
    first = x[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (x["doc"] == first["doc"]) & (x["sha"] == first["sha"]) & (x["place"] == first["place"])
    return x[new], x[~same]


def dealt(x: np.ndarray, to: np.ndarray, digests: bool) -> Iterator[tuple[int, bytes]]:
    """Where the units go, and packed the units that go there."""
    order = np.lexsort((x["place"], x["sha"], x["doc"], to))
    x, to = x[order], to[order]
    cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
    for part, k in zip(np.split(x, cuts), to[np.append(0, cuts)].tolist(), strict=True) if len(x) else ():
        yield k, packed(part, digests)


def later_units(docs: DataFrame, run_words: int, buckets: int, owners: int) -> DataFrame:
    """doc, sha, units: packed units of a document that stand earlier elsewhere; a row for each document that has any."""
    none = [np.zeros(0, UNIT)]

    def table(rows: list[tuple], kinds: dict) -> pa.Table:
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = list(none), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n
            first, later = split_first(np.concatenate(held))
            del held[1:]
            n = 0
            rows = [(k, True, u) for k, u in dealt(first, ((first["digest"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), True)]
            rows += [(k, False, u) for k, u in dealt(later, (mix(later["sha"]) % np.uint64(buckets)).astype(np.int64), False)]
            return table(rows, {"bucket": pa.int32(), "first": pa.bool_(), "units": pa.binary()}).to_batches()

        for b in batches:
            for doc, sha, text in zip(b.column(0).to_pylist(), b.column(1).to_numpy().view(np.uint64).tolist(), b.column(2).to_pylist(), strict=True):
                held.append(own := unit_rows(*word_spans(text)[:2], run_words))
                own["doc"], own["sha"] = doc, sha
                n += len(own)
                if n >= FLUSH_UNITS:
                    yield from flush()
        yield from flush()

    def settle(t: pa.Table) -> pa.Table:
        sent = [(f, unpacked(u)) for f, u in zip(t["first"].to_pylist(), t["units"].to_pylist(), strict=True)]
        _, later = split_first(np.concatenate([u for f, u in sent if f] or none))
        later = np.concatenate([later, *(u for f, u in sent if not f)])
        return table(list(dealt(later, (mix(later["sha"]) % np.uint64(owners)).astype(np.int64), False)), {"owner": pa.int32(), "units": pa.binary()})

    def gather(t: pa.Table) -> pa.Table:
        x = np.concatenate([unpacked(u) for u in t["units"].to_pylist()])
        x = x[np.lexsort((x["place"], x["sha"], x["doc"]))]
        cuts = np.flatnonzero((x["doc"][1:] != x["doc"][:-1]) | (x["sha"][1:] != x["sha"][:-1])) + 1
        rows = [(int(p["doc"][0]), int(p["sha"][:1].view(np.int64)[0]), packed(p, False)) for p in np.split(x, cuts)]
        return table(rows, {"doc": pa.int64(), "sha": pa.int64(), "units": pa.binary()})

    sent = docs.select("doc", "sha", "text").mapInArrow(send, "bucket int, first boolean, units binary")
    settled = sent.groupBy("bucket").applyInArrow(settle, "owner int, units binary")
    return settled.groupBy("owner").applyInArrow(gather, "doc long, sha long, units binary")


def runs(x: np.ndarray, run_words: int) -> list[tuple[int, int]]:
    """The first word, and the one after the last, of each run of adjacent units that has run_words or more, and of each
    line; where they overlap or touch they are one.
    """
    x = np.unique(x[["place", "words"]])
    lines, x = x[x["words"] < 0], x[x["words"] > 0]
    place, words = x["place"], x["words"].astype(np.int64)
    found = [(p, p - n) for p, n in lines.tolist()]
    cuts = np.append(0, np.flatnonzero(place[1:] != place[:-1] + words[:-1]) + 1) if len(x) else np.zeros(0, int)
    ends = np.append(cuts[1:], len(x))[: len(cuts)] - 1
    found += [(p, q) for p, q in zip(place[cuts].tolist(), (place[ends] + words[ends]).tolist(), strict=True) if q - p >= run_words]
    out: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


SPANS = "array<struct<start:int,end:int>>"


def substring_dedup(docs: DataFrame, run_words: int = RUN_WORDS, buckets: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text (what stays), n_removed (words), removed and kept (spans of the original, in
    code points; kept ones joined are text).

    Removed are lines of LINE_WORDS or more that stand earlier as lines, and runs of run_words or more inside lines or across.
    Occurrences rank by doc_id (null first), then text hash, then place; one document's own repeats are occurrences too.
    Rows that repeat doc_id and text are one document: each keeps what it keeps. Null and empty texts stay as they are, as
    do texts without words. Other columns are ignored; an empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("original"))
    keyed = rows.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("text", F.coalesce("original", F.lit(""))).withColumn("sha", F.xxhash64("text"))
    buckets = buckets or max(1, -(-input_bytes(docs) // BUCKET_BYTES))
    later = later_units(keyed, run_words, buckets, max(1, buckets * BUCKET_BYTES // OWNER_BYTES))
    joined = keyed.select("doc", "sha", "doc_id", "original").join(later, ["doc", "sha"], "left").select("doc_id", "original", "units")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts, counts, gone, stay = [], [], [], []
            for text, later in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = runs(unpacked(later), run_words) if later else []
                _, _, _, begins, stops = word_spans(text) if found else (None,) * 5
                cut = [(int(begins[i]), int(stops[j - 1])) for i, j in found]
                bounds = [0, *(x for span in cut for x in span), len(text or "")]
                kept = [(s, e) for s, e in zip(bounds[::2], bounds[1::2], strict=True) if s < e]
                texts.append("".join(text[s:e] for s, e in kept) if cut else text)
                counts.append(sum(j - i for i, j in found))
                gone.append([{"start": s, "end": e} for s, e in cut])
                stay.append([{"start": s, "end": e} for s, e in kept])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, span), pa.array(stay, span)], ["doc_id", "text", "n_removed", "removed", "kept"])

    return joined.mapInArrow(remove, f"doc_id long, text string, n_removed long, removed {SPANS}, kept {SPANS}")
