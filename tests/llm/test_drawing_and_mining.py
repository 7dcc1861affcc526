"""Importance resampling and hard negatives against brute-force versions, with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from bindery.llm import hard_negatives as mining
from bindery.llm import importance_resampling as resampling
from bindery.llm.common import numbered, stored
from bindery.llm.hard_negatives import hard_negatives
from bindery.llm.importance_resampling import resampled

SCHEMA = "doc_id long, text string, score double, rank string, Buckets string, n_words string, AT_0 string"
ODD = [None, "", "   ", "!!!", "one", "One two", "é" * 50, "A1 b2", "word " * 3000, "x" * 200_000, " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(19))]


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 0.5, "x", "y", "z", "u") for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], SCHEMA).repartition(3)


def resampled_by_hand(rows, target, longest, n_buckets, percent, least_words, seed):
    def grams(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        return len(w), [b" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g) % n_buckets
    own, wanted = (collections.Counter(bucket(g) for t in texts for g in grams(t)[1]) for texts in ([t for _, t in rows], target))
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (own.total() + n_buckets) / ((own[b] + 1) * (wanted.total() + n_buckets))))
    out = []
    for i, t in rows:
        n, found = grams(t)
        weight = sum(map(gain, map(bucket, found))) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least_words))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = len(able) * percent // 100
    return [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in out if not r[4]]


@pytest.mark.parametrize("longest,n_buckets,percent,least_words,chunk", [(2, 10000, 25, 20, 4_000_000), (1, 7, 50, 1, 100), (3, 100_000, 100, 0, 5000)])
def test_resampled(spark, monkeypatch, longest, n_buckets, percent, least_words, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(("the", "Of", "math", "proof", "x1", "ünder")) for _ in range(rng.randint(1, 80))) for _ in range(150)] + ["same text " * 15] * 40
    target = ["math proof of the math", None, "", "proof X1"]
    rows = list(zip(range(len(texts)), texts, strict=True))
    found = resampled(table(spark, texts), spark.createDataFrame([(t,) for t in target], "text string"), longest, n_buckets, percent, least_words)
    assert sorted(map(tuple, found.collect())) == sorted(resampled_by_hand(rows, target, longest, n_buckets, percent, least_words, 7))
    assert [t for _, t in found.dtypes] == ["bigint"] * 5


def test_resampled_repeated_rows_null_ids_and_no_rows(spark):
    texts, ids = ["a b c " * 10] * 6 + [None, "d " * 30], [5, 5, None, None, 7, 7, None, 5]
    target = spark.createDataFrame([], "text string")
    found = resampled(table(spark, texts, ids), target, percent=70)
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(resampled_by_hand(list(zip(ids, texts, strict=True)), [], 2, 10000, 70, 20, 7))
    assert resampled(table(spark, []), table(spark, texts)).collect() == []


def test_distinct_tuples_are_hashed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(resampling.zlib, "crc32", lambda g: seen.append(g) or 0)
    grams = resampling.Grams([b"a b a b a b", b"", b"b a"], 2)
    assert [len(list(x)) for x in grams.buckets(10)] == [2, 2]
    assert sorted(seen) == [b"a", b"a b", b"b", b"b a"]


def test_numbered(spark):
    rows = stored(spark.createDataFrame([(k % 3 if k % 7 else None, k % 5, "x") for k in range(500)], "key int, by int, at_0 string").repartition(5))
    found = numbered(rows, ["key"], ["by"], "place").collect()
    for key in (0, 1, 2, None):
        own = sorted((r.place, r.by) for r in found if r.key == key)
        assert [p for p, _ in own] == list(range(len(own))) and [b for _, b in own] == sorted(b for _, b in own)
    assert numbered(rows.filter("by > 9"), ["key"], ["by"], "place").collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, score string, Row string, block string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(3)


def mined_by_hand(rows):
    valid = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (i, v, lab) in enumerate(valid):
        if i % 100:
            continue
        score = sorted((-dot(v, w), j, b, other == lab) for b, (j, w, other) in enumerate(valid) if b != a)
        for s, j, _, _ in [x for x in score if x[3]][:5]:
            hard = [x for x in score if not x[3] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(hard)]
    return out


def spread(n, seed, width=8, scale=1.0):
    """Vectors around a few centres, many of them equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width)) * scale
    out = [(k, (centres[rng.integers(6)] + rng.normal(size=width) * 0.4 * scale).tolist(), int(rng.integers(4))) for k in range(n)]
    return out + [(n + k, [0.5] * width, k % 3) for k in range(n // 3)]


@pytest.mark.parametrize("block,list_rows,first,pack,scale", [(2048, 2048, 4, 256, 1.0), (16, 40, 1, 2, 1.0), (50, 100, 3, 4, 1e6)])
def test_hard_negatives(spark, monkeypatch, block, list_rows, first, pack, scale):
    for name, value in {"BLOCK": block, "LIST_ROWS": list_rows, "FIRST": first, "PACK": pack}.items():
        monkeypatch.setattr(mining, name, value)
    rows = spread(900, 1, scale=scale)
    rows += [(1300, None, 1), (1400, [1.0, None], 1), (1500, [math.nan] * 8, 1), (1600, [math.inf] * 8, 0), (1700, [0.3] * 8, None), (None, [0.3] * 8, 1), (1800, [0.5] * 5, 1), (1900, [], 2), (-200, [0.4] * 8, 2)]
    found = hard_negatives(vectors(spark, rows))
    assert sorted(map(tuple, found.collect())) == sorted(mined_by_hand(rows))
    assert found.dtypes == [(c, "int" if c == "rank" else "bigint") for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]


def test_hard_negatives_repeated_rows_and_no_rows(spark):
    rows = spread(150, 2) * 2
    assert sorted(map(tuple, hard_negatives(vectors(spark, rows)).collect())) == sorted(mined_by_hand(rows))
    assert hard_negatives(vectors(spark, [])).collect() == []
    assert hard_negatives(vectors(spark, [(0, [1.0], 1), (1, [1.0], 2)])).collect() == []
    with pytest.raises(Exception, match="too large"):
        hard_negatives(vectors(spark, [(0, [1e37], 1), (1, [1.0], 2)])).collect()


def test_blocks_beyond_the_floor_are_not_visited(spark):
    """What a block can hold at most is compared with the kth score: equal ones are visited, lower ones aren't."""
    directory = mining.Directory(np.array([[100.0, 0.0], [0.0, 100.0], [-100.0, 0.0]]), np.array([7, 8, 9]), np.array([0, 1, 2]), np.array([1.0, 1.0, 1.0]))
    q = np.array([[10, 0]], np.int64)
    least, most = directory.bounds(q)
    assert (least <= [[990, -10, -1010]]).all() and (most >= [[1010, 10, -990]]).all() and (most - [[1010, 10, -990]] < 2).all()

    def visited(low, high, floor, first=False, n=1):
        mining_first, mining.FIRST = mining.FIRST, n
        try:
            batch = mining.pa.RecordBatch.from_pylist([{"anchor": 1, "label": 0, "vector": q[0].tobytes(), "windows": [{"window": 0, "low": low, "high": high, "floor": floor}]}])
            return [r["block"] for out in mining.visits(directory, first, 2)([batch]) for r in out.to_pylist()]
        finally:
            mining.FIRST = mining_first

    assert visited(-5000, 5000, -5000, first=True) == [7]
    assert visited(-5000, 5000, 5) == [8] and visited(-5000, 5000, 50) == [] and visited(-5000, 5000, -5000) == [8, 9]
    assert visited(-20, 20, -5000, first=True, n=3) == [8]


def test_mining_broadcasts_no_tables(spark, monkeypatch):
    """Blocks of equal vectors take little room on disk, but not in the driver that would broadcast them."""
    joined, real = [], mining.beside
    monkeypatch.setattr(mining, "beside", lambda *x: joined.append(out := real(*x)) or out)
    hard_negatives(vectors(spark, [(k, [0.5, 0.25], k % 2) for k in range(1, 600)]))
    plans = [j._jdf.queryExecution().executedPlan().toString() for j in joined]
    assert len(plans) >= 6 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
