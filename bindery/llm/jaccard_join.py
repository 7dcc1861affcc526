"""Operator 6, n-gram Jaccard join by T-occurrence search with DivideSkip.

1. A task turns texts into sets of 64-bit shingle hashes and sends them, packed, to buckets by hash. A bucket tells which
   of a set's shingles stand in other sets too. Within a task that is settled at once, and a bucket gets such a shingle
   from a task once, so no bucket gathers the sets of a frequent shingle. Equal sets are one node; the set of a text with
   very many copies is sent for one of them.
2. Only nodes with enough shared shingles can link. Their shingles are ordered by how many of those nodes hold them; if
   two nodes link, their prefixes in this order share a shingle (prefix filter).
3. Rough search: nodes with the same least shingle hash meet in blocks, each node in one; where they need several blocks, a
   few of them that hold the most frequent shingles go to every block, so a group of near copies is connected there.
4. Search of the rest: a list of the nodes whose prefixes hold a shingle matters only where it has nodes of several
   components, and no link leaves a group of components that such lists connect. A group that fits a task is searched
   there. In larger ones, one node of each component of a list meets those of the others first. Where several components
   remain, short lists are a task each. Long ones are parted by the next atoms that links share (an atom: shingles that
   stand in the same sets), again and again as long as that sends fewer rows than blocks of the list that meet each other;
   else blocks of the nodes outside the list's largest component meet blocks of all, as a link between components has an
   end outside the largest one. So no link is lost.
5. A search task holds the inverted lists of its sets. For a set, the longest lists are put aside, the others are merged on
   a heap that skips ids which can't reach the count, and the candidates are looked up in the long lists by binary search
   (DivideSkip). Sets that are known to be connected aren't verified.
6. Links lie within components, so their numbers are counted there, in pairs of blocks where a component needs several. Near
   copies share nearly everything, so sets are told by how they differ from what most of a task's sets hold: a list of over
   half of them becomes the list of the others. Pairs that differ from it so little that they link in any case are counted by
   their sizes; for the others DivideSkip looks for enough of the same differences.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import cut, input_bytes, meet, release, stored
from bindery.llm.components import components
from bindery.llm.exact_dedup import frequent
from bindery.llm.words import BLANKS, mix, shingle_set

#: Bytes of text for a bucket; shingles that a task gathers before it sends them, and of a block of sets.
BUCKET_BYTES, FLUSH, BLOCK = 8_000_000, 250_000, 500_000
#: Sets and shingles of a block, of which a search task holds two; and how many sets go to every block of a large group.
HALF_SETS, HALF_SHINGLES, CENTRAL = 1024, 500_000, 8
COPY_COUNTERS = 16_384
#: Sets whose differences are compared with those of all others at a time; more differences than any sets share.
ROWS, NEVER = 256, 1 << 40
#: What a step on the heap costs against a step of a binary search; it says how many lists are put aside.
SKIP_COST = 0.01
NULL_ID, NOBODY = -(1 << 63), 0
U8, I8, I4 = np.dtype("<u8"), np.dtype("<i8"), np.dtype("<i4")


def needed(n: int, percent: int) -> int:
    """The least overlap with which a set of n can be linked."""
    return -(-percent * n // 100)


def least_with(n: int, smallest: int, percent: int) -> int:
    """The least overlap of a set of n with one that it links with, none of which is smaller than `smallest`."""
    return -(-percent * (n + max(smallest, needed(n, percent))) // (100 + percent))


def can_reach(percent: int) -> Column:
    """Whether a node (n) of a list whose smallest set has `smallest` can still share enough: `reach` at most."""
    partner = F.greatest(F.col("smallest"), F.ceil(F.col("n") * percent / 100))
    return F.col("reach") * (100 + percent) >= percent * (F.col("n") + partner)


def short48(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash; the bucket stands for the others."""
    return np.ascontiguousarray(h.astype(U8)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def long48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(U8).ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [f for f, _ in fields])


def runs_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def pieces(kind: int, to: np.ndarray, node: np.ndarray, size: np.ndarray, h: np.ndarray) -> Iterator[tuple]:
    """Shingles (of a node with so large a set) as packed rows: to, kind, nodes, their sizes and counts, hashes."""
    order = np.lexsort((node, to))
    to, node, size, h = to[order], node[order], size[order], h[order]
    edges = runs_of(to)
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        cuts = runs_of(node[i:j])
        yield int(to[i]), kind, node[i:j][cuts[:-1]].tobytes(), size[i:j][cuts[:-1]].astype(I4).tobytes(), np.diff(cuts).astype(I4).tobytes(), short48(h[i:j])


def owner(node: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket where a node's shared shingles meet."""
    return (mix(node) % np.uint64(buckets)).astype(np.int64)


#: kind 0: shingles whose bucket has to answer; 1: shingles known to be shared; 2: documents. For 0 and 1, ids are nodes,
#: sizes their sets' sizes, counts how many of the hashes are each one's; for 2 ids are doc_ids, hashes nodes.
SENT = "bucket int, kind int, ids binary, sizes binary, counts binary, hashes binary"
TOLD = "kind int, doc long, node long, n long, owner int, ids binary, sizes binary, counts binary, hashes binary"


def send_shingles(elements: Callable[[bytes], np.ndarray], buckets: int):
    """For mapInArrow over (doc, raw, copy): rows of SENT. Of a copy only the document is sent, its set comes with another."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int, int]] = []
        sets: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            rows: list[tuple] = []
            if docs:
                doc, node, n = (np.array(c, t) for c, t in zip(zip(*docs, strict=True), (I8, U8, I4), strict=True))
                to = (mix(doc.view(U8)) % np.uint64(buckets)).astype(np.int64)
                rows += [(int(b), 2, doc[to == b].tobytes(), n[to == b].tobytes(), b"", node[to == b].tobytes()) for b in np.unique(to)]
            if sets:
                lengths = np.array([len(s) for s in sets.values()])
                h, node, size = np.concatenate(list(sets.values())), np.repeat(np.array(list(sets), U8), lengths), np.repeat(lengths, lengths)
                order = np.argsort(h, kind="stable")
                h, node, size = h[order], node[order], size[order]
                edges = runs_of(h)
                shared = np.repeat(np.diff(edges) > 1, np.diff(edges))
                asked_h = np.append(h[~shared], h[edges[:-1]][np.diff(edges) > 1])
                asked_node = np.append(node[~shared], np.full(len(asked_h) - (~shared).sum(), NOBODY, U8))
                asked_size = np.append(size[~shared], np.zeros(len(asked_h) - (~shared).sum(), size.dtype))
                rows += pieces(0, bucket_of(asked_h, buckets), asked_node, asked_size, asked_h)
                rows += pieces(1, owner(node[shared], buckets), node[shared], size[shared], h[shared])
            docs.clear(), sets.clear()
            held = 0
            return batch(rows, SENT)

        for b in batches:
            ids, texts, copies = b.columns
            for doc, raw, copy in zip(ids.to_pylist(), texts, copies.to_pylist(), strict=True):
                s = elements(raw.as_py())
                with np.errstate(over="ignore"):
                    node = int(mix(np.array([mix(s).sum(dtype=U8) + np.uint64(len(s) + 1)], U8))[0]) if len(s) else NOBODY
                docs.append((doc, node, len(s)))
                if len(s) and not copy and node not in sets:
                    sets[node] = s
                    held += len(s)
                if held >= FLUSH or len(docs) >= FLUSH:
                    yield flush()
        yield flush()
        release()

    return send


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(I8)


def answer(buckets: int):
    """For a bucket's rows of SENT: rows of TOLD, its documents one by one, and packed by their nodes' owners the shingles
    that other nodes hold too."""

    def told(t: pa.Table) -> pa.Table:
        release()  # what the group before left
        rows: list[tuple] = []
        ids, sizes, hashes = [], [], []
        for r in t.to_pylist():
            if r["kind"] == 2:
                doc, n, node = np.frombuffer(r["ids"], I8), np.frombuffer(r["sizes"], I4), signed(np.frombuffer(r["hashes"], U8))
                rows += [(2, d, v, k, None, None, None, None, None) for d, v, k in zip(doc.tolist(), node.tolist(), n.tolist(), strict=True)]
            elif r["kind"] == 1:
                rows.append((1, None, None, None, r["bucket"], r["ids"], r["sizes"], r["counts"], r["hashes"]))
            else:
                count = np.frombuffer(r["counts"], I4)
                ids.append(np.repeat(np.frombuffer(r["ids"], U8), count)), sizes.append(np.repeat(np.frombuffer(r["sizes"], I4), count)), hashes.append(long48(r["hashes"]))
        if ids:
            node, size, h = np.concatenate(ids), np.concatenate(sizes), np.concatenate(hashes)
            order = np.lexsort((node, h))
            node, size, h = node[order], size[order], h[order]
            # a shingle is shared if two nodes hold it; NOBODY stands for several of another task
            new_pair = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
            node, size, h = node[new_pair], size[new_pair], h[new_pair]
            edges = runs_of(h)
            several = (np.diff(edges) > 1) | (node[edges[:-1]] == NOBODY)
            shared = np.repeat(several, np.diff(edges)) & (node != NOBODY)
            node, size, h = node[shared], size[shared], h[shared]
            if len(node):
                rows += [(1, None, None, None, to, *packed) for to, _, *packed in pieces(1, owner(node, buckets), node, size, h)]
        return pa.Table.from_batches([batch(rows, TOLD)])

    return told


BLOCKS = "block long, shingles long, nodes binary, sizes binary, counts binary, hashes binary"


def blocks_of(percent: int):
    """For an owner's rows: rows of BLOCKS, of the nodes that have enough shared shingles to link."""

    def gather(t: pa.Table) -> pa.Table:
        release()  # what the group before left
        counts = [np.frombuffer(x, I4) for x in t["counts"].to_pylist()]
        node = np.concatenate([np.repeat(np.frombuffer(x, U8), c) for x, c in zip(t["ids"].to_pylist(), counts, strict=True)])
        size = np.concatenate([np.repeat(np.frombuffer(x, I4), c) for x, c in zip(t["sizes"].to_pylist(), counts, strict=True)])
        h = np.concatenate([long48(x) for x in t["hashes"].to_pylist()])
        order = np.lexsort((h, node))
        node, size, h = node[order], size[order], h[order]
        new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
        node, size, h = node[new], size[new], h[new]
        edges = runs_of(node)
        count, size = np.diff(edges), size[edges[:-1]]
        able = count >= -(-percent * size.astype(np.int64) // 100)
        h, node, size, count = h[np.repeat(able, count)], node[edges[:-1]][able], size[able], count[able]
        ends = np.cumsum(count)
        rows, i = [], 0
        while i < len(node):
            start = int(ends[i] - count[i])
            j = max(i + 1, int(np.searchsorted(ends, start + BLOCK, "right")))
            rows.append((int(signed(node[i : i + 1])[0]), int(ends[j - 1]) - start, node[i:j].tobytes(), size[i:j].astype(I4).tobytes(), count[i:j].astype(I4).tobytes(), short48(h[start : int(ends[j - 1])])))
            i = j
        return pa.Table.from_batches([batch(rows, BLOCKS)])

    return gather


#: marks: of the nodes that hold a shingle, all together a hash; shingles with the same count and mark stand in the same sets
#: and are an atom. hashes and atoms (weights: shingles of each; orders: counts and marks) go by count and mark.
COUNTED = "bucket int, block long, hashes binary, counts binary, marks binary"
FREQUENT = "block long, hashes binary, counts binary, marks binary"
ORDERED = "node long, n long, shingles long, least long, central long, prefix array<long>, reach array<long>, frequency array<long>, mark array<long>, hashes binary, weights binary, orders binary"


def send_counts(buckets: int):
    """For mapInArrow over (block, nodes, counts, hashes): how many of a block's sets hold each shingle, and their mark, dealt
    to buckets.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, nodes, counts, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, own = long48(blob), mix(np.repeat(np.frombuffer(nodes, U8), np.frombuffer(counts, I4)))
                by = np.argsort(h, kind="stable")
                h, own = h[by], own[by]
                edges = runs_of(h)
                h, count, mark = h[edges[:-1]], np.diff(edges), np.bitwise_xor.reduceat(own, edges[:-1])
                to = (mix(h) % np.uint64(buckets)).astype(np.int64)
                yield batch([(int(k), block, short48(h[to == k]), count[to == k].astype(I4).tobytes(), mark[to == k].tobytes()) for k in np.unique(to)], COUNTED)

    return send


def sum_counts(t: pa.Table) -> pa.Table:
    """For a bucket's rows of COUNTED: to each block the totals of its shingles that two sets or more hold."""
    release()
    h = [long48(x) for x in t["hashes"].to_pylist()]
    kinds, place = np.unique(np.concatenate(h), return_inverse=True)
    total = np.bincount(place, np.concatenate([np.frombuffer(x, I4) for x in t["counts"].to_pylist()]), len(kinds)).astype(I4)
    mark = np.zeros(len(kinds), U8)
    np.bitwise_xor.at(mark, place, np.concatenate([np.frombuffer(x, U8) for x in t["marks"].to_pylist()]))
    rows, at = [], 0
    for block, own in zip(t["block"].to_pylist(), h, strict=True):
        here = place[at : at + len(own)]
        n, at = total[here], at + len(own)
        rows.append((block, short48(own[n > 1]), n[n > 1].tobytes(), mark[here[n > 1]].tobytes()))
    return pa.Table.from_batches([batch(rows, FREQUENT)])


def order_shingles(percent: int):
    """For a block and its rows of FREQUENT: rows of ORDERED, with each set's prefix by (count, mark), its least mixed hash,
    and how often its shingles stand in all nodes' sets, a shingle on average.
    """

    def order(blocks: pa.Table, told: pa.Table) -> pa.Table:
        release()  # what the group before left
        h = np.concatenate([long48(x) for x in told["hashes"].to_pylist()] or [np.zeros(0, U8)])
        n_sets = np.concatenate([np.frombuffer(x, I4) for x in told["counts"].to_pylist()] or [np.zeros(0, I4)]).astype(I8)
        marks = np.concatenate([np.frombuffer(x, I8) for x in told["marks"].to_pylist()] or [np.zeros(0, I8)])
        by = np.argsort(h)
        h, n_sets, marks = h[by], n_sets[by], marks[by]
        rows: list[tuple] = []
        for r in blocks.to_pylist() if len(h) else ():
            own, ends = long48(r["hashes"]), np.cumsum(np.frombuffer(r["counts"], I4))
            for node, n, i, j in zip(np.frombuffer(r["nodes"], I8).tolist(), np.frombuffer(r["sizes"], I4).tolist(), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                x = own[i:j]
                at = np.minimum(np.searchsorted(h, x), len(h) - 1)
                x, at = x[h[at] == x], at[h[at] == x]
                if len(x) >= (least := needed(n, percent)):
                    by = np.lexsort((x, marks[at], n_sets[at]))
                    x, count, mark = x[by], n_sets[at[by]], marks[at[by]]
                    first = np.flatnonzero(np.append(True, (count[1:] != count[:-1]) | (mark[1:] != mark[:-1])))
                    # the atoms after which less than `least` is left: what no other set shares comes before these
                    prefix = first[len(x) - first >= least]
                    weights, orders = np.diff(np.append(first, len(x))).astype(I4), np.append(count[first], mark[first])
                    rows.append((node, n, len(x), int(signed(mix(x)).min()), int(count.mean()), signed(x[prefix].astype(U8)).tolist(), (len(x) - prefix).tolist(), count[prefix].tolist(), mark[prefix].tolist(), short48(x), weights.tobytes(), orders.astype(I8).tobytes()))
        return pa.Table.from_batches([batch(rows, ORDERED)])

    return order


#: chain: atoms that the two nodes of a link share first, one after the other, as a hash; at: the place of the last one among
#: the node's atoms; have: shingles of the chain's atoms; reach: those and all that may follow. An end stands for links that share nothing else.
LONGER = "parent long, chain long, frequency long, mark long, node long, n long, component long, at int, have long, reach long, end int"


def lengthen(percent: int):
    """For mapInArrow over (chain, atom, node, component, at, have, n, smallest, hashes, weights, orders): rows of LONGER, for each atom
    that may be the next one that the node shares in a link; atom is the first one of a chain that has no place yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                weights = np.frombuffer(r["weights"], I4).astype(np.int64)
                firsts = np.cumsum(weights) - weights
                at, have = r["at"], r["have"]
                reps = signed(long48(r["hashes"])[firsts])
                if at is None:
                    at = int(np.flatnonzero(reps == r["atom"])[0])
                    have = int(weights[at])
                least, left = least_with(r["n"], r["smallest"], percent), int(weights.sum()) - firsts
                if have >= least:
                    rows.append((r["chain"], r["chain"], 0, 0, r["node"], r["n"], r["component"], at, have, have, 1))
                options = np.flatnonzero((np.arange(len(weights)) > at) & (left >= least - have))
                count, mark = np.frombuffer(r["orders"], I8).reshape(2, -1)
                with np.errstate(over="ignore"):
                    names = signed(mix(np.uint64(r["chain"] & (1 << 64) - 1) * np.uint64(31) + reps[options].view(U8)))
                rows += [(r["chain"], name, int(count[k]), int(mark[k]), r["node"], r["n"], r["component"], k, have + int(weights[k]), have + int(left[k]), 0) for name, k in zip(names.tolist(), options.tolist(), strict=True)]
                if len(rows) > 20_000:
                    yield batch(rows, LONGER)
                    rows = []
            yield batch(rows, LONGER)

    return run


class Links:
    """The sets of a search task, their inverted lists, and which are connected so far."""

    def __init__(self, sizes: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> None:
        """known: sets with the same number here are connected."""
        self.sizes, self.percent = sizes, percent
        ids, h = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        order = np.argsort(h, kind="stable")
        ids, h = ids[order], h[order]
        edges = runs_of(h)
        # shingles that stand in the same sets are one list, and it counts for all of them
        weights: dict[bytes, int] = {}
        for k in np.flatnonzero(np.diff(edges) > 1):
            members = ids[edges[k] : edges[k + 1]].tobytes()
            weights[members] = weights.get(members, 0) + 1
        self.lists, self.weights = [np.frombuffer(m, ids.dtype).tolist() for m in weights], list(weights.values())
        self.of: list[list[int]] = [[] for _ in sets]  # the lists that hold a set
        self.shared = [0] * len(sets)  # and how many of its shingles they are
        for k, members in enumerate(self.lists):
            for i in members:
                self.of[i].append(k)
                self.shared[i] += self.weights[k]
        self.parent, self.members = list(range(len(sets))), [1] * len(sets)
        first: dict[int, int] = {}
        for i, k in enumerate(known or ()):
            self.join(first.setdefault(k, i), i)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        if self.members[i] < self.members[j]:
            i, j = j, i
        self.parent[j] = i
        self.members[i] += self.members[j]
        return True

    def candidates(self, short: list[int], least: int, start: int = 0) -> Iterator[tuple[int, int]]:
        """Ids from `start` on that the lists `short` hold for `least` or more shingles, with their number: a heap merge that
        skips ids which can't reach it.
        """
        heap, left = [], 0
        for k in short:
            at = bisect_left(self.lists[k], start) if start else 0
            if at < len(self.lists[k]):
                heap.append((self.lists[k][at], k, at))
                left += self.weights[k]
        heapq.heapify(heap)
        while heap and left >= least:
            top, popped, count = heap[0][0], [], 0
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
                count += self.weights[popped[-1][1]]
            if count >= least:
                yield top, count
                following = top + 1
            else:
                while heap and count + self.weights[heap[0][1]] < least:
                    popped.append(heapq.heappop(heap))
                    count += self.weights[popped[-1][1]]
                if not heap:
                    return
                following = max(top + 1, heap[0][0])
            for _, k, at in popped:
                at = bisect_left(self.lists[k], following, at)
                if at < len(self.lists[k]):
                    heapq.heappush(heap, (self.lists[k][at], k, at))
                else:
                    left -= self.weights[k]

    def partners(self, i: int, again: bool = False, start: int = 0) -> Iterator[int]:
        """The sets from `start` on that link with set i, but for those already connected with it unless they are asked for
        again.
        """
        n, least = self.sizes[i], needed(self.sizes[i], self.percent)
        if self.shared[i] < least:
            return
        short, long, weight = self.divided(i, least)
        for j, count in self.candidates(short, least - weight, start):
            m = self.sizes[j]
            if j == i or 100 * min(n, m) < self.percent * max(n, m) or not (again or self.find(i) != self.find(j)):
                continue
            if self.reaches(-(-self.percent * (n + m) // (100 + self.percent)), j, count, long, weight):
                yield j

    def divided(self, i: int, least: int) -> tuple[list[int], list[int], int]:
        """The lists that hold set i: those to merge; the longest ones, put aside, where less than `least` may stand; their weight."""
        short, long, weight = sorted(self.of[i], key=lambda k: len(self.lists[k])), [], 0
        aside = min(least - 1, int(least / (SKIP_COST * math.log2(len(self.lists[short[-1]]) + 1) + 1)))
        while weight + self.weights[short[-1]] <= aside:
            long.append(short.pop())
            weight += self.weights[long[-1]]
        return short, long, weight

    def reaches(self, enough: int, j: int, count: int, long: list[int], left: int) -> bool:
        """Whether set j, counted so far, is looked up in enough of the long lists, whose weight is `left`."""
        for k in long:
            if count + left < enough:
                break
            at, members = bisect_left(self.lists[k], j), self.lists[k]
            count += self.weights[k] if at < len(members) and members[at] == j else 0
            left -= self.weights[k]
        return count >= enough

    def all(self) -> Iterator[tuple[int, int]]:
        """Links that connect whatever links connect."""
        waiting = list(range(len(self.sizes)))
        while waiting:
            largest = max((self.find(i) for i in range(len(self.sizes))), key=lambda r: self.members[r])
            outside = [i for i in waiting if self.find(i) != largest]
            if not outside:
                return
            # every link between components has an end outside the largest one
            found = False
            for k, i in enumerate(outside):
                for j in self.partners(i):
                    if self.join(i, j):
                        found = True
                        yield i, j
                if found:
                    break
            queried = set(outside[: k + 1])
            waiting = [i for i in waiting if i not in queried]


class Differences(Links):
    """The sets by how they differ from what most of them hold: lists of more than half of the sets are those of the others."""

    def __init__(self, sizes: list[int], sets: list[np.ndarray], percent: int) -> None:
        super().__init__(sizes, sets, percent)
        far = [n - shared for n, shared in zip(sizes, self.shared, strict=True)]  # shingles that one set only holds
        for k, members in enumerate(self.lists):
            if 2 * len(members) > len(sets):
                held = set(members)
                self.lists[k] = [i for i in range(len(sets)) if i not in held]
        self.of, self.shared = [[] for _ in sets], [0] * len(sets)
        for k, members in enumerate(self.lists):
            for i in members:
                self.of[i].append(k)
                self.shared[i] += self.weights[k]
        self.far = [a + b for a, b in zip(far, self.shared, strict=True)]  # how many differences each set has

    def counts(self, copies: list[int], n_low: int) -> list[int]:
        """For each set, the copies of the other sets that it links with; of the sets from n_low on for one before, and the other
        way round, if n_low isn't 0.
        """
        size, far, weight = (np.array(x, np.int64) for x in (self.sizes, self.far, copies))
        found, n = np.zeros(len(copies), np.int64), len(copies)
        for k in range(0, n_low or n, ROWS):
            one, other = slice(k, min(k + ROWS, n_low or n)), slice(n_low, n)
            enough = self.enough((size[one, None], far[one, None]), (size[other], far[other]))
            if not n_low:
                enough[np.arange(n) <= np.arange(n)[one, None]] = NEVER  # each pair once
            found[one] += (enough <= 0) @ weight[other]
            found[other] += weight[one] @ (enough <= 0)
            enough[(enough <= 0) | (enough > np.minimum(far[one, None], far[other]))] = NEVER
            for i, least in enumerate(enough.min(1).tolist(), k):
                if least <= self.shared[i]:
                    for j in self.alike(i, least, n_low or i + 1):
                        found[i] += copies[j]
                        found[j] += copies[i]
        return found.tolist()

    def enough(self, a: tuple, b: tuple):
        """How many differences two sets, told by size and differences, share at least if they link; if it's 0 or less, they do.

        Two sets differ in what either differs in but for twice what both do; it may be this share of both sizes.
        """
        return -(((100 - self.percent) * (a[0] + b[0]) // (100 + self.percent) - a[1] - b[1]) // 2)

    def alike(self, i: int, least: int, start: int) -> Iterator[int]:
        """The sets from `start` on that link with set i as they share differences, of which `least` are needed at least."""
        short, long, weight = self.divided(i, least)
        for j, count in self.candidates(short, least - weight, start):
            enough = self.enough((self.sizes[i], self.far[i]), (self.sizes[j], self.far[j]))
            if enough > 0 and self.reaches(enough, j, count, long, weight):
                yield j


def search(percent: int):
    """For a search task's rows: links between nodes of different components. A node may be there more than once."""

    def link(t: pa.Table) -> pa.Table:
        own = {node: k for k, node in enumerate(t["node"].to_pylist())}
        t = t.take(list(own.values()))
        nodes = list(own)
        links = Links(t["n"].to_pylist(), [long48(x) for x in t["hashes"].to_pylist()], percent, t["component"].to_pylist())
        return pa.Table.from_batches([batch([(nodes[i], nodes[j]) for i, j in links.all()], "a long, b long")])

    return link


def count_links(percent: int):
    """For the rows of a pair of blocks: for its nodes, how many documents of the other block (of the same one, if there is
    only one) they link with.
    """

    def count(t: pa.Table) -> pa.Table:
        t = t.sort_by([("low", "descending"), ("node", "ascending")])  # a pair is looked for from its first set only
        n_low, one = sum(t["low"].to_pylist()), t["low_block"][0] == t["high_block"][0]
        found = [0] * t.num_rows
        if one or 0 < n_low < t.num_rows:  # a block may be empty
            found = Differences(t["n"].to_pylist(), [long48(x) for x in t["hashes"].to_pylist()], percent).counts(t["copies"].to_pylist(), 0 if one else n_low)
        return pa.Table.from_batches([batch(list(zip(t["node"].to_pylist(), found, strict=True)), "node long, links long")])

    return count


def blocks_needed(sets: str, shingles: str, half_sets: int) -> Column:
    return F.ceil(F.greatest(F.col(sets) / half_sets, F.col(shingles) / HALF_SHINGLES)).cast("int")


def block_of(blocks: str, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(blocks).cast("long")).cast("int")


def others(blocks: str, own: str) -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.col(blocks) - 1), lambda k: k != F.col(own)))


#: A node in a list; atom is the list's atom, shingle its name.
POST = ["shingle", "atom", "frequency", "mark", "reach", "node", "n", "component", "central", "shingles"]


def rough_links(ordered: DataFrame, nodes: int, percent: int) -> DataFrame:
    """a, b: links within groups of nodes that have the same least hash; each node is sent to one block, of large groups
    CENTRAL nodes to all.
    """
    groups = cut(ordered.groupBy("least").agg(F.count("*").alias("sets"), F.sum("shingles").alias("all_shingles")).filter("sets > 1"))
    groups = groups.withColumn("blocks", blocks_needed("sets", "all_shingles", HALF_SETS))
    dealt = meet(ordered.select("least", "node", "n", "central", "hashes"), groups, "least", "sets", nodes).withColumn("block", block_of("blocks"))
    best = F.row_number().over(Window.partitionBy("least").orderBy(F.desc("central"), "node"))
    central = dealt.filter("blocks > 1").select("least", "node", "central", "block", "blocks").withColumn("best", best).filter(F.col("best") <= CENTRAL)
    central = central.select("least", "node", others("blocks", "block").alias("block")).join(ordered.select("node", "n", "hashes"), "node")
    columns = ["least", "block", "node", "n", "hashes", F.col("node").alias("component")]
    return dealt.select(*columns).unionByName(central.select(*columns)).groupBy("least", "block").applyInArrow(search(percent), "a long, b long")


def same_nodes() -> list[Column]:
    return [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same{k}") for k in range(2)]


def contested(posts: DataFrame, percent: int) -> DataFrame:
    """posts (POST) with all (the list's length), low (its least component) and smallest (its smallest set's size): those whose shingle has nodes of several
    components; of lists that hold the same nodes, as 128 bits of their hashes tell, the one that comes first by (frequency,
    mark), as all their nodes share that atom too. Nodes that can't share enough with any of their list are left out.
    """
    lists = posts.groupBy("shingle").agg(F.count("*").alias("all"), F.min("n").alias("smallest"), F.min("component").alias("low"), F.max("component").alias("high"), F.first(F.struct("frequency", "mark")).alias("order"), *same_nodes())
    lists = cut(lists.filter("low < high").groupBy("all", "low", "same0", "same1").agg(F.min_by(F.struct("shingle", "smallest"), F.struct("order", "shingle")).alias("one")).select("one.*", "all", "low"))
    return stored(meet(posts, lists, "shingle", "all", posts.count()).filter(can_reach(percent)).select(*POST, "all", "low", "smallest"))


def grown(components_: DataFrame, links: DataFrame) -> DataFrame:
    """node, root: the components that further links (a, b) make of components."""
    return components(links.unionByName(components_.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def length_class(n: Column, percent: int) -> Column:
    """Of two sets that link, the classes are the same or neighbours."""
    return F.floor(F.log(n.cast("double")) / -math.log(percent / 100 - 0.005)).cast("int")


def remaining(ordered: DataFrame, rough: DataFrame, percent: int, by_length: bool) -> DataFrame:
    """node, root: the components, given those of the rough search.

    No link leaves a group of components that contested lists connect. A group that fits a task is searched there, each
    node sent once; lists of larger groups are searched one by one.
    """
    sets = ordered.select("node", "n", "hashes", "weights", "orders")
    posts = ordered.select("node", "n", "central", "shingles", F.inline(F.arrays_zip("prefix", "reach", "frequency", "mark"))).withColumnRenamed("prefix", "atom").withColumn("shingle", F.col("atom"))
    if by_length:
        length = length_class(F.col("n"), percent)
        posts = posts.withColumn("length", F.explode(F.array(length, length + 1))).withColumn("shingle", F.xxhash64("length", "shingle"))
    posts = posts.join(rough, "node", "left")
    posts = contested(stored(posts.withColumn("component", F.coalesce("root", "node")).select(*POST)), percent)
    groups = components(posts.select(F.col("component").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("component"), F.col("root").alias("task"))
    nodes = stored(posts.select("node", "component", "shingles").distinct().join(groups, "component"))
    size = cut(nodes.groupBy("task").agg(F.count("*").alias("sets"), F.sum("shingles").alias("all_shingles")).withColumn("small", (F.col("all_shingles") <= 2 * HALF_SHINGLES) & (F.col("sets") <= 2 * HALF_SETS)))
    nodes = meet(nodes, size, "task", "sets", nodes.count())
    links = nodes.filter("small").select("task", "node", "component").join(sets.drop("weights", "orders"), "node").groupBy("task").applyInArrow(search(percent), "a long, b long")
    if size.filter("NOT small").limit(1).count():
        large = nodes.filter("NOT small").select("node").distinct()
        links = links.unionByName(links_by_lists(stored(posts.join(large, "node", "left_semi")), sets, rough, percent))
    return grown(rough, links)


def links_by_lists(posts: DataFrame, sets: DataFrame, rough: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect whatever links connect between components of contested lists.

    First the most central node of each component in a list meets those of the others; what is contested after that is
    searched in full: short lists as they are, of longer ones the parts that further shared atoms make.
    """
    plain = sets.drop("weights", "orders")
    links = plain.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    best = cut(posts.groupBy("shingle", "component").agg(F.max(F.struct("central", "node"))["node"].alias("node")))
    lists = cut(best.groupBy("shingle").agg(F.count("*").alias("several"))).withColumn("blocks", F.ceil(F.col("several") / (2 * HALF_SETS)))
    if 2 * (n := best.count()) <= posts.count():  # else components are small, and this would be a search of nearly all
        best = meet(best, lists, "shingle", "several", n).withColumn("block", block_of("blocks"))
        links = cut(best.join(plain, "node").groupBy("shingle", "block").applyInArrow(search(percent), "a long, b long"))
        root = grown(rough, links).select(F.col("node").alias("component"), "root")
        posts = contested(stored(posts.drop("all", "low", "smallest").join(root, "component", "left").withColumn("component", F.coalesce("root", "component")).select(*POST)), percent)
    tasks = posts.filter(F.col("all") <= 2 * HALF_SETS).select("shingle", F.lit(0).alias("outer"), F.lit(0).alias("inner"), "node", "component")
    chains = posts.filter(F.col("all") > 2 * HALF_SETS).select(F.col("shingle").alias("chain"), "all", "smallest", "atom", "node", "component", F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("have"))
    while chains.limit(1).count():
        chains, more, ends = parted(chains, sets, percent)
        tasks, links = tasks.unionByName(more), links.unionByName(ends)
    return links.unionByName(tasks.join(plain, "node").groupBy("shingle", "outer", "inner").applyInArrow(search(percent), "a long, b long"))


def sent(n: str) -> Column:
    """Rows that a list of so many nodes sends to search tasks: a short one once, blocks of a longer one to each other."""
    return F.when(F.col(n) <= 2 * HALF_SETS, F.col(n)).otherwise(F.col(n) * F.ceil(F.col(n) / HALF_SETS))


def parted(chains: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For long lists, the nodes that hold a chain of atoms: the still long ones of their parts by the next atom that two nodes
    of a link share; search tasks; and links.

    A node is in a part for each atom that can be the next. Where all nodes of a list hold one, links share it or an earlier
    one, so later ones are left out. Links that share nothing after the chain are told by the sizes: who links at all does so
    with the smallest. A list whose parts would send more rows than its blocks is searched by blocks.
    """
    rows = chains.join(sets, "node").select("chain", "atom", "node", "component", "at", "have", "n", "smallest", "hashes", "weights", "orders")
    longer = stored(rows.mapInArrow(lengthen(percent), LONGER))
    sizes = cut(chains.groupBy("chain").agg(F.first("all").alias("whole")).withColumnRenamed("chain", "parent"))
    parts = longer.filter("end = 0").groupBy("parent", "chain").agg(F.count("*").alias("all"), F.min("n").alias("smallest"), F.min("component").alias("low"), F.max("component").alias("high"), F.first(F.struct("frequency", "mark")).alias("order"), *same_nodes())
    parts = parts.join(sizes, "parent")
    everyone = cut(parts.filter(F.col("all") == F.col("whole")).groupBy("parent").agg(F.min("order").alias("last")))
    parts = cut(parts.join(everyone, "parent", "left").filter(F.col("last").isNull() | (F.col("order") <= F.col("last"))).filter("low < high"))
    costs = sizes.join(parts.groupBy("parent").agg(F.sum(sent("all")).alias("cost")), "parent", "left")
    costs = cut(costs.withColumn("parts", F.coalesce("cost", F.lit(0)) < sent("whole")))
    good = costs.filter("parts").select("parent")
    parts = parts.join(good, "parent")
    short = parts.filter(F.col("all") <= 2 * HALF_SETS).groupBy("all", "low", "same0", "same1").agg(F.min(F.struct("chain", "smallest")).alias("one")).select("one.*", "all")
    kept = cut(short.unionByName(parts.filter(F.col("all") > 2 * HALF_SETS).select("chain", "smallest", "all")))
    found = stored(meet(longer.filter("end = 0"), kept, "chain", "all", longer.count()).filter(can_reach(percent)))
    tasks = found.filter(F.col("all") <= 2 * HALF_SETS).select(F.col("chain").alias("shingle"), F.lit(0).alias("outer"), F.lit(0).alias("inner"), "node", "component")
    following = found.filter(F.col("all") > 2 * HALF_SETS).select("chain", "all", "smallest", F.lit(None).cast("long").alias("atom"), "node", "component", "at", "have")
    ends = longer.filter("end = 1").join(good, "parent", "left_semi").join(everyone, "parent", "left_anti")
    smallest = cut(ends.groupBy("parent").agg(F.min(F.struct("n", "node")).alias("least"), F.count("*").alias("members")).filter("members > 1"))
    told = meet(ends, smallest, "parent", "members", longer.count()).filter((F.col("node") != F.col("least.node")) & (100 * F.col("have") >= percent * (F.col("n") + F.col("least.n") - F.col("have"))))
    links = told.select(F.col("node").alias("a"), F.col("least.node").alias("b"))
    return following, tasks.unionByName(by_blocks(chains.join(costs.filter("NOT parts").select(F.col("parent").alias("chain")), "chain", "left_semi"))), links


def by_blocks(long: DataFrame) -> DataFrame:
    """Search tasks (shingle, outer, inner, node, component) for lists (chain, all, node, component): blocks of the nodes
    outside a list's largest component meet blocks of all.
    """
    long = stored(long.select(F.col("chain").alias("shingle"), "all", "node", "component"))
    parts = long.groupBy("shingle", "all", "component").agg(F.count("*").alias("sets")).groupBy("shingle", "all")
    parts = cut(parts.agg(F.max(F.struct("sets", "component")).alias("main")).select("shingle", "all", F.col("main.component").alias("main"), (F.col("all") - F.col("main.sets")).alias("outside")))
    parts = parts.withColumn("inners", F.ceil(F.col("all") / HALF_SETS).cast("int")).withColumn("outers", F.ceil(F.col("outside") / HALF_SETS).cast("int"))
    dealt = meet(long.drop("all"), parts, "shingle", "all", long.count())
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    as_inner = dealt.select("shingle", every("outers").alias("outer"), block_of("inners").alias("inner"), "node", "component")
    as_outer = dealt.filter("component != main").select("shingle", block_of("outers", 1).alias("outer"), every("inners").alias("inner"), "node", "component")
    return as_inner.unionByName(as_outer)


def links_of_nodes(ordered: DataFrame, linked: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """node, links: for the nodes of components (node, root), the number of documents of other nodes that they link with."""
    sets = stored(ordered.select("node", "n", "shingles", "hashes").join(linked, "node").join(copies, "node"))
    groups = cut(sets.groupBy("root").agg(F.count("*").alias("sets"), F.sum("shingles").alias("all_shingles")))
    groups = groups.withColumn("blocks", blocks_needed("sets", "all_shingles", HALF_SETS))
    dealt = meet(sets, groups, "root", "sets", sets.count()).withColumn("block", block_of("blocks"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low = F.col("block") <= F.col("other")
    pairs = pairs.select("root", F.least("block", "other").alias("low_block"), F.greatest("block", "other").alias("high_block"), low.cast("int").alias("low"), "node", "n", "hashes", "copies")
    return pairs.groupBy("root", "low_block", "high_block").applyInArrow(count_links(percent), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def marked_copies(keyed: DataFrame) -> DataFrame:
    """keyed with copy: whether the row repeats one of the most frequent texts and another doc_id stands for that text.

    The frequent texts are found by a heavy-hitter search of their digests; at most COPY_COUNTERS of them are broadcast.
    """
    digest = F.sha2("raw", 256)
    digests = cut(keyed.select("doc", digest.alias("digest")))
    winners = digests.join(F.broadcast(frequent(digests, "digest", COPY_COUNTERS)), "digest").groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    winners = cut(winners.filter("n > 1").select("digest", "first"))
    joined = keyed.withColumn("digest", digest).join(F.broadcast(winners), "digest", "left")
    return joined.select("doc", "raw", F.coalesce(F.col("doc") != F.col("first"), F.lit(False)).alias("copy"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, buckets: int | None = None, count: bool = True, elements: Callable[[bytes], np.ndarray] | None = None, by_length: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included),
    and, unless count is False, n_links: how many other documents the document links with, its equals among them.

    Texts are lower-cased in A-Z; words stand between ASCII white space; a set holds the distinct runs of `words` words, or
    the whole sequence if it is shorter. Two documents link when 100 * intersection >= percent * union. Null and empty
    texts and those without words have no shingle and link with nothing. Equal sets link. A null doc_id counts as the
    smallest: its component_id is null. Rows that repeat a doc_id are documents of their own. Other columns are ignored;
    an empty table gives no row.

    elements gives a text's set otherwise, from its bytes to sorted distinct 64-bit hashes. With by_length, a list of nodes is
    kept for each length class of the sets, and a node is in those of its own and of the next class.

    Counting verifies each pair of different sets that may link, so it takes time by the number of links; the components
    alone don't.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    buckets = buckets or max(1, -(-input_bytes(docs) // BUCKET_BYTES))
    told = stored(marked_copies(keyed).mapInArrow(send_shingles(elements or (lambda raw: shingle_set(raw.lower(), words, BLANKS)), buckets), SENT).groupBy("bucket").applyInArrow(answer(buckets), TOLD))
    documents = told.filter("kind = 2").select("doc", "node", "n")
    shared = told.filter("kind = 1").select("owner", "ids", "sizes", "counts", "hashes")
    blocks = stored(shared.groupBy("owner").applyInArrow(blocks_of(percent), BLOCKS))
    total = blocks.agg(F.sum("shingles")).first()[0] or 0
    counts = blocks.select("block", "nodes", "counts", "hashes").mapInArrow(send_counts(max(1, -(-total // BLOCK))), COUNTED).groupBy("bucket").applyInArrow(sum_counts, FREQUENT)
    ordered = stored(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(order_shingles(percent), ORDERED))
    linked = remaining(ordered, components(rough_links(ordered, ordered.count(), percent)), percent, by_length)
    classes = cut(documents.filter("n > 0").groupBy("node").agg(F.min("doc").alias("first"), F.count("*").alias("copies")))
    smallest = classes.join(linked, "node").groupBy("root").agg(F.min("first").alias("smallest"))
    labels = classes.join(linked.join(smallest, "root"), "node", "left").select("node", "copies", F.coalesce("smallest", "first").alias("label"))
    if count:
        labels = labels.join(links_of_nodes(ordered, linked, classes.select("node", "copies"), percent), "node", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1)
    else:
        labels = labels.withColumn("links", F.lit(0).cast("long"))
    apart = documents.filter("n = 0").select("doc", "n", F.col("doc").alias("label"), F.lit(0).cast("long").alias("links"))
    found = meet(documents.filter("n > 0"), stored(labels), "node", "copies", documents.count()).select("doc", "n", "label", "links").unionByName(apart)
    null_back = lambda c: F.when(c != NULL_ID, c)
    columns = [null_back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), null_back(F.col("label")).alias("component_id")]
    return found.select(*columns, *[F.col("links").alias("n_links")] * count)
