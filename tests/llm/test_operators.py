"""The training-data operators against brute-force versions, on small tables with every odd case."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bindery.llm import jaccard_join, license_scan, mixing, regression, toxicity, words
from bindery.llm.components import components
from bindery.llm.exact_dedup import deduplicated, exact_dedup, misra_gries
from bindery.llm.jaccard_join import Links, jaccard_components
from bindery.llm.quality import quality_scores
from bindery.llm.common import LOWER, UPPER
from bindery.llm.spot_signatures import COMMON, fingerprint, fingerprints, from_fingerprint, likeness, matched, signatures, sketch, spots
from bindery.llm.substring_dedup import substring_dedup, units
from bindery.llm.token_output import CapacityTree, best_fit_decreasing, packed_ids
from bindery.llm.tokens import Encoder, default_path
from bindery.llm.toxicity import toxicity_scores
from bindery.llm.vector_packing import Packer, answers, pack, pack_conversations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id string, node string, kept string"


def table(spark, texts, ids=None):
    """documents with extra columns whose names clash with those of the operators."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 20}", None, 0.5, "x", "y", "z") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def prose(n, seed):
    rng, kinds = random.Random(seed), vocabulary(400)
    out = [rng.choice(kinds) for _ in range(n)]
    for k in range(0, n, 9):
        out[k] = out[k].capitalize()
        if k:
            out[k - 1] += "."
    return " ".join(out)


ODD = [None, "", "   ", "\n\n", "!!!", "one", "One two", "é" * 50, "word " * 3000, "x" * 200_000]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 5 > 0, int(i % 4 == 0)) for i in range(400)] + [(None, True, 1), (3, None, None)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "CAST(quality AS INT) AS quality", "toxic")


# exact dedup


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_exact_dedup(spark, counters):
    texts = [*ODD, *(["hot"] * 60), *ODD, *(f"t{i % 7}" for i in range(40)), "Hot", "hot "]
    rows = exact_dedup(table(spark, texts), counters).collect()
    group = collections.defaultdict(list)
    for i, t in enumerate(texts):
        group[t or ""].append(i)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        own = group[texts[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_exact_dedup_repeated_rows_null_ids_and_no_rows(spark):
    docs = table(spark, ["a", "a", "a", "b", "b"], [1, 1, None, None, None])
    for counters in (1, 1024):
        rows = exact_dedup(docs, counters).collect()
        assert sum(r.kept for r in rows) == 2 and len(rows) == 5
        assert {(r.keep_id, r.group_size) for r in rows} == {(1, 3), (None, 2)}
        assert sorted((r.doc_id, r.text) for r in deduplicated(docs, counters).select("doc_id", "text").collect() if r.doc_id) == [(1, "a")]
        assert deduplicated(docs, counters).count() == 2
    assert exact_dedup(docs.limit(0)).count() == 0


def test_misra_gries_keeps_every_frequent_key():
    keys = ["a"] * 40 + ["b"] * 35 + [str(i) for i in range(25)]
    random.Random(3).shuffle(keys)
    held = misra_gries(keys, 3)
    assert {"a", "b"} <= held.keys() and held["a"] >= 40 - 100 // 4


# substring dedup


def removed_by_hand(texts, run_words):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        late = []
        for k, (digest, start, end, n) in enumerate(units(t or "")):
            if digest in seen:
                late.append((k, start, end, n))
            seen.add(digest)
        found, run = [], []
        for u in [*late, None]:
            if u and (not run or run[-1][0] + 1 == u[0]):
                run.append(u)
                continue
            if run and sum(x[3] for x in run) >= run_words:
                found.append((run[0][1], run[-1][2]))
            run = [u] if u else []
        out[i] = found
    return out


@pytest.mark.parametrize("buckets", [1, 5])
def test_substring_dedup(spark, buckets):
    passage = prose(70, 99)
    texts = [*ODD, passage, *(f"{prose(40, s)}\n{passage}\n{prose(30, s + 50)}" for s in range(8)), *(f"{prose(20, s)} {passage} {prose(20, s)}" for s in range(20, 24)), prose(60, 7), prose(60, 7)]
    rows = substring_dedup(table(spark, texts), buckets=buckets).collect()
    by_hand = removed_by_hand(texts, 25)
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert [(x.start, x.end) for x in r.removed] == by_hand[r.doc_id]
        assert "".join((text or "")[x.start : x.end] for x in r.kept) == (r.text or "")
        if r.doc_id > len(ODD) and passage in (text or ""):
            assert passage not in r.text
    assert next(r.text for r in rows if r.doc_id == len(ODD)) == passage


def test_substring_dedup_repeated_rows_stay(spark):
    text = prose(80, 1)
    rows = substring_dedup(table(spark, [text, text, text], [4, 4, 9])).collect()
    assert sorted((r.doc_id, r.text == text) for r in rows) == [(4, True), (4, True), (9, False)]
    assert substring_dedup(table(spark, ["a"]).limit(0)).count() == 0


def test_substring_dedup_inside_lines(spark):
    def plain(n, seed):
        return prose(n, seed).lower().replace(".", "")

    texts = []
    for s in range(100, 130):
        passage = plain(51 + s % 3 * 20, s)
        texts += [f"{plain(10 + s % 7, s + 200)} {passage} {plain(9, s + 300)}", f"{plain(8, s + 400)} {passage} {plain(10 + s % 5, s + 500)}"]
    rows = {r.doc_id: r for r in substring_dedup(table(spark, texts), buckets=3).collect()}
    for i in range(0, len(texts), 2):
        assert rows[i].n_removed == 0 and rows[i].text == texts[i]
        n = 51 + (100 + i // 2) % 3 * 20
        assert n - 24 <= rows[i + 1].n_removed <= n  # some words at the edges stay
        assert all(texts[i + 1][x.start : x.end] in texts[i] for x in rows[i + 1].removed)


def test_substring_dedup_removes_short_lines_that_repeat(spark):
    line, short = "Please read our nine word notice before you go.", "All rights reserved"
    texts = [f"{prose(30, s)}\n{line}\n{short}\n{prose(30, s + 40)}" for s in range(700, 720)] + [f"{prose(12, 800)} {line} {prose(12, 801)}", f"{line}\n{prose(30, 802)}\n{line}"]
    rows = {r.doc_id: r for r in substring_dedup(table(spark, texts), buckets=3).collect()}
    for i, t in enumerate(texts[:20]):
        assert (rows[i].text, rows[i].n_removed) == ((t, 0) if i == 0 else (t.replace(line, ""), 9))
    assert rows[20].text == texts[20]  # no line of its own, and less than a run
    assert (rows[21].text, rows[21].n_removed) == (texts[21].replace(line, ""), 18)


def test_substring_dedup_of_lines_by_hand(spark):
    """Of each line of four words or more all occurrences but the first by (doc_id, place) go, whatever stands around them."""
    rng = random.Random(11)
    kinds = [" ".join(f"l{k}w{i}" for i in range(rng.choice([4, 5, 7, 12, 24, 40]))) for k in range(60)]
    texts = ["\n".join(rng.choices(kinds, [1 / (k + 1) for k in range(60)], k=rng.randrange(1, 15))) for _ in range(80)]
    seen, expected = set(), []
    for t in texts:
        own = []
        for line in t.split("\n"):
            own.append("" if len(line.split()) >= 4 and line in seen else line)
            seen.add(line)
        expected.append("\n".join(own))
    rows = {r.doc_id: r for r in substring_dedup(table(spark, texts), buckets=4).collect()}
    squeezed = lambda t: [x for x in t.split("\n") if x.strip()]
    assert [squeezed(rows[i].text) for i in range(80)] == [squeezed(t) for t in expected]
    assert sum(t != e for t, e in zip(texts, expected, strict=True)) > 40


# n-gram Jaccard join


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_by_hand(texts, k, percent):
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}, [len(s) for s in sets]


def links_by_hand(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    return {i: sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)) for i, a in enumerate(sets)}


def near_copies(base, n, seed, edits):
    rng, w = random.Random(seed), base.split()
    out = []
    for i in range(n):
        own = list(w)
        for _ in range(edits):
            own[rng.randrange(len(own))] = f"edit{seed}x{i}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("half_sets", "flush", "block"), [(256, 2_000_000, 1_000_000), (3, 300, 200)])
def test_jaccard_components(spark, monkeypatch, half_sets, flush, block):
    monkeypatch.setattr(jaccard_join, "HALF_SETS", half_sets)
    monkeypatch.setattr(jaccard_join, "FLUSH", flush)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    line = prose(20, 500)
    texts = [*ODD, "ONE", "one two"]
    for s in range(6):
        texts += near_copies(prose(120, s), 7, s, s)
    texts += near_copies(prose(200, 77), 30, 77, 2)
    texts += [f"{line} {prose(15, 600 + s)}" for s in range(12)] + [line] * 5 + [" ".join(line.split()[:i]) for i in range(10, 20)]
    by_hand, sizes = components_by_hand(texts, 4, 85)
    rows = jaccard_components(table(spark, texts), buckets=5).collect()
    assert {r.doc_id: r.component_id for r in rows} == by_hand
    assert {r.doc_id: r.n_shingles for r in rows} == dict(enumerate(sizes))
    assert {r.doc_id: r.n_links for r in rows} == links_by_hand(texts, 4, 85)
    rows = jaccard_components(table(spark, texts), words=5, percent=80, buckets=3, count=False).collect()
    assert {r.doc_id: r.component_id for r in rows} == components_by_hand(texts, 5, 80)[0] and "n_links" not in rows[0]


def test_jaccard_sends_rows_by_the_nodes(spark, monkeypatch):
    """A group of near copies of one text is sent to search tasks in rows by its size, not by its pairs."""
    monkeypatch.setattr(jaccard_join, "HALF_SETS", 16)
    sent, task = [], jaccard_join.search
    counter = spark.sparkContext.accumulator(0)

    def counted(percent):
        link = task(percent)

        def run(t):
            counter.add(t.num_rows)
            return link(t)

        return run

    monkeypatch.setattr(jaccard_join, "search", counted)
    for n in (200, 400, 800):
        before = counter.value
        rows = jaccard_components(table(spark, near_copies(prose(150, 9), n, 9, 1)), buckets=2, count=False).collect()
        assert {r.component_id for r in rows} == {0}
        sent.append(counter.value - before)
    assert sent[0] <= 4 * 200 and sent[2] <= 5 * sent[0]


def templates(n, seed, passages=20, variants=3, words=8):
    """Texts of the same passages in one of some variants each: they share much, and hardly any two link."""
    rng = random.Random(seed)
    kinds = [[" ".join(f"p{k}v{v}w{w}" for w in range(words)) for v in range(variants)] for k in range(passages)]
    return [" ".join(rng.choice(k) for k in kinds) for _ in range(n)]


def test_texts_that_do_not_link_are_sent_by_their_number(spark, monkeypatch):
    """What search tasks get grows with the texts, not with the pairs that share passages."""
    monkeypatch.setattr(jaccard_join, "HALF_SETS", 16)
    sent, task = [], jaccard_join.search
    counter = spark.sparkContext.accumulator(0)

    def counted(percent):
        link = task(percent)

        def run(t):
            counter.add(t.num_rows)
            return link(t)

        return run

    monkeypatch.setattr(jaccard_join, "search", counted)
    for n in (400, 800, 1600):
        before = counter.value
        texts = templates(n, 4) + near_copies(templates(1, 5)[0], 3, 8, 1)
        rows = jaccard_components(table(spark, texts), buckets=2, count=False).collect()
        assert {r.doc_id: r.component_id for r in rows} == components_by_hand(texts, 4, 85)[0]
        sent.append(counter.value - before)
    assert sent[2] < 2.5**2 * sent[0] and sent[0] < 20 * 400, sent


@pytest.mark.parametrize(("passages", "variants", "half_sets", "by_length"), [(6, 2, 4, False), (8, 2, 3, True), (30, 2, 4, False), (5, 4, 2, False), (40, 1, 2, False)])
def test_long_lists_lose_no_link(spark, monkeypatch, passages, variants, half_sets, by_length):
    """Texts of few variants, many of which link: lists are parted, ended or met in blocks, and components stay exact."""
    monkeypatch.setattr(jaccard_join, "HALF_SETS", half_sets)
    rng = random.Random(passages)
    texts = templates(90, passages, passages, variants, 5)
    texts += [f"{t} {' '.join(f'own{k}x{w}' for w in range(rng.randint(0, 30)))}" for k, t in enumerate(texts[:40])]
    rows = jaccard_components(table(spark, texts), buckets=2, by_length=by_length, percent=80).collect()
    assert {r.doc_id: r.component_id for r in rows} == components_by_hand(texts, 4, 80)[0]
    assert {r.doc_id: r.n_links for r in rows} == links_by_hand(texts, 4, 80)


def test_shingles_of_the_same_sets_are_one_list():
    sets = [np.arange(1, 100, dtype=np.uint64), np.arange(1, 95, dtype=np.uint64), np.arange(1, 98, dtype=np.uint64)]
    links = Links([len(s) for s in sets], sets, 85)
    assert sorted(zip(links.lists, links.weights, strict=True)) == [([0, 1, 2], 94), ([0, 2], 3)] and links.shared == [97, 94, 97]
    assert [sorted(links.partners(k)) for k in range(3)] == [[1, 2], [0, 2], [0, 1]]


def test_jaccard_null_ids_and_no_rows(spark):
    text = prose(50, 1)
    rows = jaccard_components(table(spark, [text, text, "", prose(50, 2)], [5, None, 6, 7])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == [(5, None), (6, 6), (7, 7), (None, None)]
    assert jaccard_components(table(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("cost", [0.001, 0.01, 1])
def test_search_finds_all_links(monkeypatch, cost):
    monkeypatch.setattr(jaccard_join, "SKIP_COST", cost)
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) > 0.06], rng.integers(1, 1 << 40, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(60)]
    links = Links([len(s) for s in sets], sets, 85)
    for i in range(60):
        exact = {j for j in range(60) if j != i and 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - both)}
        assert {j for j in links.partners(i) if j != i} == exact
        assert {j for j in links.partners(i, True, 20)} == {j for j in exact if j >= 20}


def test_search_merges_skips_and_probes(monkeypatch):
    """What DivideSkip doesn't look at: ids that the short lists can't hold often enough, and most places of long lists."""
    looked, find = [], jaccard_join.bisect_left
    monkeypatch.setattr(jaccard_join, "bisect_left", lambda members, *at: looked.append(len(members)) or find(members, *at))
    common, own = np.arange(1, 101, dtype=np.uint64), np.arange(1000, 1000 + 40 * 400, dtype=np.uint64).reshape(400, 40)
    # every set holds the common shingles but for one, only those of one pair share the rest as well
    sets = [np.unique(np.concatenate([np.delete(common, k % 100), own[k if k != 399 else 0]])) for k in range(400)]
    links = Links([len(s) for s in sets], sets, 85)
    assert sorted(j for k in range(400) for j in links.partners(k)) == [0, 399]
    assert list(links.partners(0)) == [399] and looked and sum(looked) > 0
    taken = []
    monkeypatch.setattr(jaccard_join.heapq, "heappop", lambda heap, pop=jaccard_join.heapq.heappop: taken.append(1) or pop(heap))
    assert list(links.partners(5)) == [] and not taken  # too few of its shingles are shared
    assert list(links.partners(0)) == [399] and len(taken) < 400 * 20  # of about 140 lists with 400 ids each


@pytest.mark.parametrize(("percent", "low"), [(80, 0), (85, 0), (80, 120), (85, 1)])
def test_links_of_near_copies_are_counted_by_their_differences(monkeypatch, percent, low):
    """All links, also of sets far from the others, within a block (low 0) or between two; lists of near copies aren't merged."""
    rng = np.random.default_rng(percent + low)
    base, other, few = (rng.integers(1, 1 << 40, n).astype(np.uint64) for n in (120, 120, 12))
    new = lambda n: rng.integers(1, 1 << 40, n).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(120) > rng.choice([0.01, 0.04, 0.12])], new(rng.integers(0, 6))])) for _ in range(300)]
    sets += [np.unique(np.concatenate([other[rng.random(120) > 0.05], new(2)])) for _ in range(20)]
    sets += [np.unique(rng.choice(few, 5)) for _ in range(30)] + [new(3) for _ in range(5)]
    sets = list({s.tobytes(): s for s in sets}.values())
    rng.shuffle(sets := np.array(sets, object))
    copies, n = rng.integers(1, 9, len(sets)), len(sets)
    expected = [0] * n
    for i in range(n):
        for j in range(n):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if i != j and (not low or (i < low) != (j < low)) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                expected[i] += int(copies[j])
    taken = []
    monkeypatch.setattr(jaccard_join.heapq, "heappop", lambda heap, pop=jaccard_join.heapq.heappop: taken.append(1) or pop(heap))
    columns = {"low_block": [0] * n, "high_block": [int(low > 0)] * n, "low": [int(not low or i < low) for i in range(n)], "node": list(range(n)), "n": [len(s) for s in sets], "hashes": [jaccard_join.short48(s) for s in sets], "copies": copies.tolist()}
    found = jaccard_join.count_links(percent)(pa.table(columns))
    assert dict(zip(found["node"].to_pylist(), found["links"].to_pylist(), strict=True)) == dict(enumerate(expected)) and sum(expected) > 500
    assert len(taken) < n * n, len(taken)  # lists as they are take some nine times as many within a block


@pytest.mark.parametrize("in_one_task", [1_000_000, 3])
def test_components(spark, in_one_task):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (90, 95), (200, 201), (7, 7), (-5, -9)] + [(500, 500 + i) for i in range(1, 40)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), in_one_task).collect()}
    assert found == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200, -5: -9, -9: -9, **{500 + i: 500 for i in range(40)}}
    assert components(spark.createDataFrame([], "a long, b long"), in_one_task).count() == 0


def test_word_hashes():
    text = b" one two\tone\n  caf\xc3\xa9 two "
    h = words.word_hashes(text, words.BLANKS)
    assert len(h) == 5 and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    long = b" ".join(b"w%d" % (i % 1000) for i in range(300_000)) + b" " + b"y" * 1_500_000 + b" z"
    h = words.word_hashes(long, words.BLANKS)
    assert len(h) == 300_002 and len(np.unique(h)) == 1002 and (h[:1000] == h[1000:2000]).all()


# packing


def check_pieces(rows, ids):
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc]) and r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    return sequences


def test_pack(spark):
    encoder = Encoder(default_path())
    texts = [*ODD, *(prose(n, n) for n in range(5, 400, 7)), "a <|endoftext|> b", prose(3000, 5)]
    ids = {i: encoder.document(t) for i, t in enumerate(texts)}
    sequences = check_pieces(pack(table(spark, texts)).collect(), ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert pack(table(spark, ["a"]).limit(0)).count() == 0


def test_encoder_agrees_with_its_library():
    encoder = Encoder(default_path())
    for text in [*filter(None, ODD), "It's  a\ttest\n\n  of <|endoftext|> 123½ Ünïcode 日本語 😀", prose(50, 3)]:
        assert encoder.ids(text).tolist() == encoder.slow().encode(text, add_special_tokens=False).ids


def test_packer_keeps_all_limits():
    rng = random.Random(2)
    packer = Packer(0, 64, 4, 40, 16)
    lengths = [rng.randrange(1, 150) for _ in range(200)]
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4"), rng.choice([0, 0, n // 2, n]))
    packer.finish()
    by = collections.defaultdict(list)
    for doc, start, n, _, _, sequence, offset, loss, _ in packer.rows:
        by[sequence].append((offset, n, loss, doc, start))
    for own in by.values():
        assert sum(x[1] for x in own) <= 64 and len(own) <= 4 and sum(x[2] for x in own) <= 40
        assert [x[0] for x in sorted(own)] == np.cumsum([0, *(x[1] for x in sorted(own))])[:-1].tolist()
    tokens = collections.Counter()
    for own in by.values():
        for _, n, _, doc, _ in own:
            tokens[doc] += n
    assert [tokens[i] for i in range(200)] == lengths


def packed_by_hand(docs, capacity, segments, loss, pool):
    """(doc, start, length, sequence) of dot-product packing, piece by piece, of (tokens, first that bears loss) documents."""
    out, waiting, sequence = [], [], 0
    bears = lambda p, n: sum(1 for i in range(p[1], p[1] + n) if i >= p[3])

    def close(placed):
        nonlocal sequence
        total, at, rest = sum(n for _, n in placed), 0, []
        room = total if total == capacity else 2 ** int(math.log2(total))
        for p, n in placed:
            n = min(n, room - at)
            if n:
                out.append((p[0], p[1], n, sequence))
            at += n
            rest.append((p[0], p[1] + n, p[2] - n, p[3]))
        sequence += 1
        return [p for p in rest if p[2]]

    def fill():
        left, placed = [capacity, segments, loss], []
        while waiting and left[0] and left[1]:
            fitting = [k for k, p in enumerate(waiting) if p[2] <= left[0] and bears(p, p[2]) <= left[2]] if left[1] > 1 else []
            if fitting:
                dot = lambda k: sum(a / m * b / m for a, b, m in zip((waiting[k][2], 1, bears(waiting[k], waiting[k][2])), left, (capacity, segments, loss), strict=True))
                k = max(fitting, key=lambda k: (round(dot(k), 12), -k))
                n = waiting[k][2]
            else:
                most = [max((n for n in range(min(p[2], left[0]) + 1) if bears(p, n) <= left[2]), default=0) for p in waiting]
                n = max(most)
                k = most.index(n)
                if not n:
                    break
            p = waiting[k]
            waiting[k] = waiting[-1]
            waiting.pop()
            placed.append((p, n))
            left = [left[0] - n, left[1] - 1, left[2] - bears(p, n)]
        waiting.extend(close(placed))

    for doc, (n, loss_from) in enumerate(docs):
        p = (doc, 0, n, loss_from)
        while p[2] >= capacity:
            p = next(iter(close([(p, min(capacity, max(0, loss_from - p[1]) + loss))])), (doc, n, 0, loss_from))
        if p[2]:
            waiting.append(p)
            while len(waiting) >= pool:
                fill()
    while waiting:
        fill()
    return out


@pytest.mark.parametrize(("segments", "loss"), [(4, 40), (16, 64), (3, 20)])
def test_packer_agrees_with_packing_by_hand(segments, loss):
    rng = random.Random(segments)
    docs = [(n := rng.choice([1, 2, 5, 9, 20, 45, 130]), rng.choice([0, n // 2, n])) for _ in range(150)]
    packer = Packer(0, 64, segments, loss, 12)
    for i, (n, loss_from) in enumerate(docs):
        packer.add(i, np.arange(n, dtype="<u4"), loss_from)
    packer.finish()
    assert [(r[0], r[1], r[2], r[5]) for r in packer.rows] == packed_by_hand(docs, 64, segments, loss, 12)


def test_short_texts_are_packed_without_padding(spark):
    texts = [" ".join(["word"] * (i % 5)) for i in range(20_000)]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    lengths = collections.Counter()
    for r in rows:
        lengths[r.sequence_id] += r.length
    assert all(n & (n - 1) == 0 for n in lengths.values()) and max(lengths.values()) <= 2048
    assert sum(lengths.values()) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_conversations_are_packed_by_their_answers(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", prose(1 + (c * 7 + t * 13) % 60, c * 10 + t)) for c in range(80) for t in range(6)]
    turns += [(90, 0, "assistant", None), (90, 1, None, "asks"), (None, 0, "user", ""), (None, 1, "assistant", "yes"), (91, 0, "user", "a"), (91, 1, "system", "b"), (91, 2, "assistant", "c"), (91, 2, "assistant", "d")]
    table_ = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    examples = {(r.doc_id, r.turn, r.text): r.prompt for r in answers(table_).collect()}
    assert examples[91, 2, "c"] == "a\nb" and examples[91, 2, "d"] == "" and examples[90, 0, ""] == "" and examples[90, 1, ""] == "asks" and examples[None, 1, "yes"] == ""
    encoder, expected = Encoder(default_path()), collections.Counter()
    for (doc, turn, text), _ in examples.items():
        expected[doc, turn] += len(encoder.document(text))
    rows = pack_conversations(table_.coalesce(1), loss=300).collect()
    bear, tokens, by_doc = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        bear[r.sequence_id] += r.loss_tokens
        tokens[r.sequence_id] += r.length
        by_doc[r.doc_id, r.part] += r.loss_tokens
    assert by_doc == expected and max(bear.values()) <= 300 and max(tokens.values()) <= 2048 and any(b == 300 for b in bear.values())
    assert pack_conversations(table_.limit(0)).count() == 0


# token output


def test_packed_ids_round_trip(spark):
    encoder = Encoder(default_path())
    texts = [*ODD, *(prose(n, n) for n in range(5, 300, 11)), prose(4000, 8)]
    rows = packed_ids(table(spark, texts), length=256, window_tokens=3000).collect()
    got = collections.defaultdict(dict)
    for r in rows:
        matrix = np.frombuffer(r.input_ids, "<u2")
        assert len(matrix) == 256 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert r.ids_crc32 == zlib.crc32(matrix[: r.n_tokens].astype("<u4").tobytes())
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            got[doc][start] = matrix[r.cu_seqlens[k] : r.cu_seqlens[k + 1]]
    for i, t in enumerate(texts):
        assert np.concatenate([got[i][s] for s in sorted(got[i])]).tolist() == encoder.document(t).tolist()
    assert packed_ids(table(spark, ["a"]).limit(0)).count() == 0


def test_capacity_tree_finds_the_tightest():
    rng, tree, free = random.Random(4), CapacityTree(100), []
    for _ in range(500):
        if free and rng.random() < 0.5:
            need = rng.randrange(1, 101)
            best = min((f for f in free if f >= need), default=None)
            found = tree.tightest(need)
            assert (found and found[0]) == best
            if best is not None:
                free.remove(best)
        else:
            free.append(rng.randrange(1, 101))
            tree.put(free[-1], [])


@pytest.mark.parametrize("length", [64, 100])
def test_best_fit_decreasing_by_hand(length):
    rng, tree = random.Random(length), CapacityTree(length)
    free: list[int] = []
    for window in range(4):  # later windows go on with the open sequences of earlier ones
        lengths = [rng.choice([1, 2, 3, 7, 20, 33, 50, length]) for _ in range(200)]
        full = best_fit_decreasing([(i, 0, range(n)) for i, n in enumerate(lengths)], tree, length)
        done = 0
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
            if (left := (min(fits) if fits else length) - n):
                free.append(left)
            else:
                done += 1
        assert len(full) == done and all(sum(len(p[2]) for p in s) == length for s in full)
        assert sorted(f for f, _ in tree.all() for _ in (0,)) == sorted(free) and all(f == length - sum(len(p[2]) for p in s) for f, s in tree.all())


# fingerprints


def test_fingerprints(spark):
    texts = [*ODD, *(prose(n, n) for n in (20, 60, 200, 900)), prose(60, 60)]
    rows = {r.doc_id: r for r in fingerprints(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (sketch(signatures(x)) for x in (t, edited, following))
        assert rows[i].near_edited == likeness(a, b) and rows[i].near_next == likeness(a, c)
        size, members = from_fingerprint(rows[i].fingerprint)
        assert size == a[0] and members.tolist() == a[1].tolist()
    assert rows[len(texts) - 1].fingerprint == rows[len(ODD) + 1].fingerprint
    assert rows[len(ODD) + 3].near_edited > 0.4 and rows[len(ODD) + 3].near_next < 0.1


def test_fingerprints_of_one_row_repeated_ids_and_no_rows(spark):
    one = fingerprints(table(spark, ["only text here"], [7])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = fingerprints(table(spark, ["b", "a", "c", "d"], [2, 2, None, 2])).collect()
    assert sorted((r.doc_id for r in rows), key=str) == [2, 2, 2, None]
    assert fingerprints(table(spark, ["a"]).limit(0)).count() == 0


def test_spots_by_hand():
    text = "The quick brown fox IS very lazy and the dog"
    common = {"the", "is", "and"}
    w = text.lower().split()
    content = [i for i, x in enumerate(w) if x not in common]
    by_hand = {(x, *([w[j] for j in content if j > i][:2])) for i, x in enumerate(w) if x in common and any(j > i for j in content)}
    assert by_hand == {("the", "quick", "brown"), ("is", "very", "lazy"), ("and", "dog"), ("the", "dog")}
    assert len(spots(text.encode())) == 4 and set(spots(b"the quick brown x").tolist()) <= set(spots(text.encode()).tolist())
    for plain in ("lonely", "the", "two words", "the of and"):
        assert len(spots(plain.encode())) > 0
    assert spots(b"alpha beta gamma").tolist() != spots(b"alpha beta delta").tolist() and not len(spots(b""))


def spots_by_hand(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER)))
    content = [i for i, x in enumerate(w) if x not in COMMON] or list(range(len(w)))
    following = lambda i, own: (w[i], *[w[j] for j in content if j > i - own][:2])
    return {following(i, 0) for i, x in enumerate(w) if x in COMMON and any(j > i for j in content)} or {following(i, 1) for i in content} or ({text} if text else set())


def test_fingerprints_by_hand(spark):
    rng, kinds = random.Random(8), [*vocabulary(30), *sorted(COMMON)[:20], "él", "Größe"]
    texts = [*ODD, *(" ".join(rng.choice(kinds) for _ in range(n)).capitalize() + "." for n in (1, 2, 5, 30, 80, 300, 301, 40))]
    texts.append(texts[-2])
    rows = {r.doc_id: r for r in fingerprints(table(spark, texts)).collect()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own = spots_by_hand(t)
        assert rows[i].near_next == pytest.approx(jaccard(own, spots_by_hand(following))) and rows[i].near_edited == pytest.approx(jaccard(own, spots_by_hand(edited)))
        assert rows[i].n_signatures == len(own)


def test_matched_against_all_pairs(spark):
    texts = [*ODD, "!!!"]
    for s in range(5):
        texts += near_copies(prose(150, 900 + s), 6, 900 + s, 1 + s)
        texts += [" ".join(prose(150, 900 + s).split()[:n]) for n in (100, 120, 130, 140)]
    sets = [set(spots((t or "").encode()).tolist()) for t in texts]
    alike = {i: [j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)}
    rows = {r.doc_id: r for r in matched(table(spark, texts)).collect()}
    assert {i: r.n_links for i, r in rows.items()} == {i: len(x) for i, x in alike.items()} and sum(map(len, alike.values())) > 100
    for i, r in rows.items():
        seen, left = {i}, [i]
        while left:
            left = [j for k in left for j in alike[k] if j not in seen and not seen.add(j)]
        assert r.component_id == min(seen) and r.n_signatures == len(sets[i])


def test_likeness_prunes_by_length():
    a, b = (10, np.arange(10, dtype="<u4")), (5, np.arange(5, dtype="<u4"))
    assert likeness(a, b) == 0.5 and likeness(a, b, 0.6) == 0.0 and likeness((0, a[1][:0]), (0, a[1][:0])) == 1.0 and likeness(a, (0, a[1][:0])) == 0.0


def test_likeness_of_long_texts_is_exact(spark):
    words = [w.capitalize() for w in vocabulary(3000, 6)]
    text = " ".join(f"the {w}" for w in words)
    own = signatures(text)
    rows = {r.doc_id: r for r in fingerprints(table(spark, [text, " ".join(text.split()[:4800]) + " of nothing else"])).collect()}
    following = signatures(" ".join(text.split()[:4800]) + " of nothing else")
    assert len(own) > 2000 and rows[0].near_next == len(set(own.tolist()) & set(following.tolist())) / len(set(own.tolist()) | set(following.tolist()))
    size, members = from_fingerprint(rows[0].fingerprint)
    assert size == len(members) and members.tolist() == own.tolist()
    # sets that differ in their largest members only
    a, b = np.arange(400, dtype="<u4"), np.append(np.arange(300, dtype="<u4"), np.arange(500, 600, dtype="<u4"))
    assert likeness(sketch(a), sketch(b)) == 300 / 500 and fingerprint(sketch(a)) != fingerprint(sketch(b))


# classifiers


def test_quality_held_out_accuracy(spark):
    texts = [prose(40, i) if i % 5 else " ".join(w + "$$$" for w in prose(40, i).split()) for i in range(400)] + ODD
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)], "doc_id long, quality int")
    rows = quality_scores(table(spark, texts), labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.doc_id < 400 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == int(r.doc_id % 5 > 0) for r in held) > 0.95 * len(held)


def test_toxicity_held_out_accuracy_and_places(spark):
    def text(i):
        parts = [prose(12, 10 * i + k) for k in range(5)]
        if i % 4 == 0:
            parts[i % 5] += f" you {('vilest', 'nastiest', 'foulest')[i // 4 % 3]} thing"
        return ". ".join(parts) + "."

    texts = [text(i) for i in range(400)] + ODD
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = toxicity_scores(table(spark, texts), labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id < 400 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) > 0.95 * len(held)
    for r in rows:
        for s in r.offending:
            assert any(w in texts[r.doc_id][s.start : s.end] for w in ("vilest", "nastiest", "foulest", "thing", "you"))


def test_toxicity_places_are_code_points_and_linear(spark, labels):
    rng, kinds = random.Random(3), vocabulary(80)
    texts = []
    for i in range(400):
        parts = [" ".join(rng.choice(kinds) for _ in range(6)) for _ in range(5)]
        if i % 4 == 0:
            parts[2] = "you vilest thing é " + parts[2]
        texts.append(". ".join(parts) + ".")
    long = "Größe ist é. Nothing here! You vilest thing é. " * 20_000
    began = time.time()
    rows = {r.doc_id: r for r in toxicity_scores(table(spark, [*texts, long]), labels).collect()}
    found = rows[400].offending
    assert len(found) >= 20_000 and all("vilest" in long[s.start : s.end] for s in found[::997]) and time.time() - began < 90
    assert found[0].end == long.index(".", long.index("vilest"))


def test_noisy_or_and_its_training():
    z = np.array([-1.0, 0.5])
    assert toxicity.noisy_or(z, 3, -2.0) == pytest.approx(1 - (1 - 1 / (1 + math.exp(1))) * (1 - 1 / (1 + math.exp(-0.5))) * (1 - 1 / (1 + math.exp(2))) ** 3)
    # two words in bags of two sentences: word 0 is in every positive bag, word 1 anywhere
    ids = np.array([0, 1, 1, 1, 0, 1])
    sentence_of, bag_of = np.arange(6), np.array([0, 0, 1, 1, 2, 3])
    plain, y = np.array([0.0, 0, 1, 1]), np.array([1.0, 0, 1, 0])
    weights, bias = toxicity.train_weights(ids, sentence_of, bag_of, plain, y, 2)
    loss = lambda w, b: -sum(math.log(max(1e-12, p if t else 1 - p)) for t, p in zip(y, [toxicity.noisy_or(b + w[ids[bag_of == k]], plain[k], b) for k in range(4)], strict=True)) / 4
    assert weights[0] > 3 > weights[1] and loss(weights, bias) < 0.05 < loss(np.zeros(2), -6.0)


def test_ridge_minimises_its_loss():
    rng = np.random.default_rng(1)
    x, y = np.hstack([rng.normal(size=(200, 6)), np.ones((200, 1))]), rng.integers(0, 2, 200).astype(float)
    w = regression.ridge(x.T @ x, x.T @ y, 0.3)
    loss = lambda v: ((x @ v - y) ** 2).sum() + 0.3 * (v[:-1] ** 2).sum()
    assert all(loss(w) < loss(w + step) for step in rng.normal(size=(500, 7)) * 0.01)
    assert abs((x @ w - y).sum()) < 1e-6  # the constant isn't shrunk


def test_isotonic_knots_by_the_formula():
    rng = np.random.default_rng(2)
    score, n = np.arange(60) / 60, rng.integers(1, 9, 60).astype(float)
    p = np.minimum(n, np.floor(n * np.clip(score + rng.normal(size=60) * 0.4, 0, 1)))
    mean = lambda i, j: p[i : j + 1].sum() / n[i : j + 1].sum()
    fitted = [max(min(mean(i, j) for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    groups = [[k for k in range(60) if abs(fitted[k] - v) < 1e-12] for v in sorted({round(f, 12) for f in fitted})]
    groups = [g for g in groups if g]
    x, y = regression.isotonic_knots(score, p, n)
    assert np.allclose(x, [(score[g] * n[g]).sum() / n[g].sum() for g in groups])
    assert np.allclose(y, np.maximum.accumulate([(p[g].sum() + 0.5) / (n[g].sum() + 1) for g in groups]))


def test_classifiers_without_labels_or_rows(spark, labels):
    docs = table(spark, [*ODD, "text"], [*range(len(ODD)), None])
    none = labels.limit(0)
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    assert len(toxicity_scores(docs, none).collect()) == len(ODD) + 1
    assert len(quality_scores(docs, labels).collect()) == len(ODD) + 1
    assert quality_scores(docs.limit(0), labels).count() == 0 and toxicity_scores(docs.limit(0), labels).count() == 0


# license scan


def test_license_scan(spark):
    bsd = next(t for label, _, t in license_scan.TEMPLATES if label == "bsd")
    texts = [
        *ODD, "Released under the MIT License.", "under the mit license, under THE mit-license", "Apache License, Version 2.0 and cc by-nc", "under the mit", "x " + bsd.replace("in source", "in any source"),
        "GNU General Public License, version 3", "under the mit foo license", "gnu general public license version",
    ]
    rows = {r.doc_id: r for r in license_scan.license_scan(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    got = [(rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels, rows[i].labels) for i in range(len(ODD), len(texts))]
    assert got == [(1, 1, 1, "mit", "mit"), (2, 0, 4, "mit", "mit"), (2, 0, 6, "apache-2,cc-by-nc", "apache-2,cc-by-nc"), (0, None, None, "", ""), (0, None, None, "", "bsd"), (0, None, None, "", "gpl-3"), (0, None, None, "", ""), (0, None, None, "", "")]
    assert rows[1].n_words == 0 and rows[8].n_words == 3000
    repeated = license_scan.license_scan(table(spark, ["under the mit license"] * 2 + ["cc by nc"], [1, 1, None])).collect()
    assert sorted((str(r.doc_id), r.n_base) for r in repeated) == [("1", 1), ("1", 1), ("None", 1)]  # a row for a row, as the SQL gives
    assert license_scan.license_scan(table(spark, ["a"]).limit(0)).count() == 0


def test_license_scan_takes_time_by_the_words(spark):
    text = " ".join(f"w{i % 977}" for i in range(400_000)) + " under the mit license"
    docs = table(spark, [text]).coalesce(1).cache()
    assert docs.count() == 1
    began = time.time()
    (row,) = license_scan.license_scan(docs).collect()
    assert time.time() - began < 15 and (row.n_words, row.n_base, row.first_word) == (400_004, 1, 400_000)


# mixing


def filled(budget, children):
    """Water-filling by repeated sharing: name -> (weight, capacity)."""
    given, open_, left = {}, dict(children), budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k for k, (w, c) in open_.items() if c <= w * left / total}
        if not full:
            return given | {k: int(w * left / total) for k, (w, _) in open_.items()}
        for k in full:
            given[k] = open_.pop(k)[1]
            left -= given[k]
    return given


def test_mixing_budgets(spark):
    rng = random.Random(5)
    texts = [None if i % 50 == 0 else prose(rng.randrange(1, 60), i) for i in range(300)]
    docs = table(spark, texts, [i if i % 3 else i * 20 + 20_000 for i in range(300)])
    m = mixing.Mixture(share=1.1, max_epochs=2)
    base = {r.doc_id: r for r in docs.collect()}
    rows = mixing.mix(docs, m).collect()
    names = ("web", "books", "code", "reference")
    leaf_of = {i: (names[int(r.source[3:]) // 5], r.lang or "unknown", r.source) for i, r in base.items()}
    tokens = {i: len((r.text or "").split()) for i, r in base.items()}
    leaves = collections.Counter()
    for i in base:
        leaves[leaf_of[i]] += tokens[i]
    given = {}
    top = filled(int(sum(leaves.values()) * m.share), {d: (m.domains[d], 2 * sum(v for k, v in leaves.items() if k[0] == d)) for d in {k[0] for k in leaves}})
    for d, b in top.items():
        langs = filled(b, {lang: (m.langs.get(lang, m.other), 2 * sum(v for k, v in leaves.items() if k[:2] == (d, lang))) for lang in {k[1] for k in leaves if k[0] == d}})
        for lang, c in langs.items():
            for s, n in filled(c, {k[2]: (1, 2 * v) for k, v in leaves.items() if k[:2] == (d, lang)}).items():
                given[d, lang, s] = n
    expected = {}
    for leaf, n in given.items():
        own = [i for i in base if leaf_of[i] == leaf]
        whole = n // leaves[leaf] if leaves[leaf] else 1
        part, at = n - whole * leaves[leaf], 0
        for i in sorted(own, key=lambda i: hashlib.md5(f"{m.seed}|{whole}|{i}".encode()).hexdigest()):
            at += tokens[i]
            if epochs := whole + (part > 0 and 2 * at - tokens[i] <= 2 * part):
                expected[i] = epochs
    assert {r.doc_id: r.epochs for r in rows} == expected


def test_mixing_odd_cases(spark):
    assert mixing.mix(table(spark, ["a"]).limit(0)).count() == 0
    rows = mixing.mix(table(spark, ["a b", "a b", None, ""], [1, 1, None, 2]), mixing.Mixture(share=1.0)).collect()
    # a leaf without tokens comes once, whole; the twice repeated row fills its leaf's capacity
    assert sorted((str(r.doc_id), r.n_tokens, r.epochs) for r in rows) == [("1", 2, 1), ("1", 2, 1), ("2", 0, 1), ("None", 0, 1)]


def test_mixing_without_weight(spark):
    docs = table(spark, [prose(40, i) for i in range(60)] + [None, ""])
    domains = {"web": 0, "books": 30, "code": 0, "reference": 10}
    rows = mixing.mix(docs, mixing.Mixture(share=1.0, domains=domains, langs={"en": 1, "unknown": 0}, other=3)).collect()
    assert rows and {r.domain for r in rows} == {"books", "reference"} and {r.lang for r in rows} == {"en"}
    assert mixing.mix(docs, mixing.Mixture(domains={}, other=0)).count() == 0
