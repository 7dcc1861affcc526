"""Operator 13, hard negatives by inverted lists of a k-means index.

1. A bounded sample of the vectors fits centroids; every row goes to the list of its nearest centroid. Lists lie in blocks
   of at most BLOCK rows in order of their distance from the centroid, each stored with its radius, so that a list that
   holds a third of all rows is many blocks.
2. For an anchor q, Cauchy-Schwarz bounds a block's scores: q.c - |q|r <= q.x <= q.c + |q|r. An anchor visits its FIRST
   blocks in order of the upper bound; their kth best score is the floor for the rest: of these it visits those whose bound
   isn't strictly below it. Blocks that lie outside all its windows are skipped.
3. The positives of an anchor are a search for its own label without a window, its negatives one for other labels with a
   window a positive. A visit sends an anchor to a block, packed with the others that visit it; scores are products of
   matrices of integers, so results are exact and equal those of all anchors against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import release, sampled, stored

#: Components of the rows that fit the centroids; rows of a block; rows for a centroid; the most centroids, and about the
#: most blocks.
FIT_VALUES, BLOCK, LIST_ROWS, MOST_LISTS, MOST_BLOCKS = 4_000_000, 2048, 2048, 4096, 1_000_000
#: Blocks that an anchor visits before it has a floor; anchors of a pack; cells of a matrix of bounds.
FIRST, PACK, CELLS = 4, 256, 4_000_000
STEPS = 10
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

BLOCKS = "list int, radius double, size int, ids binary, rows binary, labels binary, vectors binary"
PACKS = "block long, anchors binary, labels binary, vectors binary, of binary, windows binary, low binary, high binary"
HITS = "anchor long, window long, score long, id long, row long"


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of vectors as floor(256 * component), with zeros after a short vector's end."""
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(values).max(initial=0) >= 2.0**62:
        raise ValueError("a component is too large for whole numbers of 64 bits")
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """x in two bytes a component, or in eight where they are needed."""
    return np.ascontiguousarray(x, np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int64)


def matrix(blob: bytes, rows: int, width: int) -> np.ndarray:
    """The vectors of so many rows, of two or of eight bytes a component."""
    return np.frombuffer(blob, np.int16 if len(blob) == rows * width * 2 else np.int64).reshape(rows, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact: in floating point where no sum can reach 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("inner products of these vectors don't fit 64 bits")


def fitted(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of the vectors by k-means; those without a vector stay where they were."""
    centres = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].astype(np.float64) if len(vectors) else np.zeros((1, vectors.shape[1]))
    for _ in range(STEPS if len(vectors) else 0):
        own = nearest(vectors, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    step = max(1, CELLS // len(centres))
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(vectors[k : k + step] @ centres.T - half, 1) for k in range(0, len(vectors), step))])


def packed_rows(width: int):
    """For mapInArrow over (embedding): the vector in whole numbers, in as few bytes as it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([narrow(row).tobytes() for row in whole_numbers(b.column(0), width)], pa.binary())], ["vector"])

    return run


def assigned(centres: np.ndarray, width: int):
    """For mapInArrow over (id, row, label, embedding): with list, distance and the vector in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole_numbers(b.column(3), width)
            own = nearest(x.astype(np.float64), centres)
            far = np.sqrt(((x - centres[own]) ** 2).sum(1))
            packed = pa.array([row.tobytes() for row in narrow(x)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own.astype(np.int32)), pa.array(far), packed], ["id", "row", "label", "list", "distance", "vector"])

    return run


def packed_blocks(block: int, width: int):
    """For mapInArrow over rows in order of list and distance: rows of BLOCKS, the vectors in as few bytes as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t["list"].to_numpy()
            edges = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1).tolist(), len(lists)]
            spans = [(k, min(k + block, j)) for i, j in zip(edges[:-1], edges[1:], strict=True) for k in range(i, j, block)]
            if not last:  # what comes may belong to the last block
                spans = spans[:-1]
            rows = []
            for i, j in spans:
                part = t.slice(i, j - i)
                x = np.concatenate([matrix(v, 1, width) for v in part["vector"].to_pylist()])
                ids, of, label = (part[c].to_numpy().astype(np.int64).tobytes() for c in ("id", "row", "label"))
                rows.append((int(lists[i]), float(part["distance"].to_numpy().max()), j - i, ids, of, label, narrow(x).tobytes()))
            held[:] = t.slice(spans[-1][1] if spans else 0).to_batches()
            yield arrow(rows, BLOCKS)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) > 2 * block:
                yield from cut(False)
        if held:
            yield from cut(True)
        release()

    return run


def arrow(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [f for f, _ in fields])


class Directory:
    """What an anchor has to know of the blocks: centroids, and of each block its list and radius."""

    def __init__(self, centres: np.ndarray, blocks: np.ndarray, lists: np.ndarray, radii: np.ndarray) -> None:
        self.centres, self.blocks, self.lists, self.radii = centres, blocks, lists, radii

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score that each block can hold for each row of q, with room for rounding."""
        length = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None]
        middle = (q @ self.centres.T)[:, self.lists]
        reach = length * self.radii[None, :] * (1 + 1e-9) + length * np.sqrt((self.centres**2).sum(1))[self.lists][None, :] * 1e-9 + 1
        return middle - reach, middle + reach


def visits(directory: Directory, first: bool, width: int):
    """For mapInArrow over (anchor, label, vector, windows): rows of PACKS for an anchor's FIRST blocks by their bounds, or for
    all others that may hold what it looks for. A window is (window, low, high, floor): scores from low to high count, and
    below floor they come too late.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(PACK, CELLS // max(1, len(directory.blocks))))
        for b in batches:
            for at in range(0, b.num_rows, step):
                yield from packs(b.slice(at, step))
        release()

    def packs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchors, labels = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        q = np.concatenate([matrix(v, 1, width) for v in b.column(2).to_pylist()]).astype(np.int64)
        windows = b.column(3).to_pylist()
        of = np.repeat(np.arange(len(q)), [len(w) for w in windows])
        window, low, high, floor = (np.array([x[k] for w in windows for x in w], np.int64) for k in ("window", "low", "high", "floor"))
        least, most = directory.bounds(q)

        def wanted(from_: np.ndarray) -> np.ndarray:
            """Anchors by blocks: whether one of an anchor's windows, from from_ on, meets the block."""
            out = np.zeros(most.shape, bool)
            np.logical_or.at(out, of, (most[of] >= from_[:, None]) & (least[of] <= high[:, None]))
            return out

        open_ = wanted(low)
        ranked = np.argsort(np.where(open_, -most, np.inf), 1, kind="stable")[:, :FIRST]
        early = np.zeros_like(open_)
        np.put_along_axis(early, ranked, True, 1)
        early &= open_
        going = early if first else wanted(np.maximum(low, floor)) & ~early
        rows = []
        for k in np.flatnonzero(going.any(0)).tolist():
            who = np.flatnonzero(going[:, k])
            place = np.full(len(q), -1)
            place[who] = np.arange(len(who))
            # only windows that meet the block go with their anchor
            meets = (place[of] >= 0) & (most[of, k] >= np.maximum(low, floor)) & (least[of, k] <= high)
            rows.append((int(directory.blocks[k]), anchors[who].tobytes(), labels[who].tobytes(), narrow(q[who]).tobytes(), place[of[meets]].tobytes(), window[meets].tobytes(), np.maximum(low, floor)[meets].tobytes(), high[meets].tobytes()))
            if len(rows) == PACK:
                yield arrow(rows, PACKS)
                rows = []
        yield arrow(rows, PACKS)

    return run


def scored(k: int, same: bool, width: int):
    """For mapInArrow over packs joined with their blocks: rows of HITS, a block's k best for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield hits(r)
        release()

    def hits(r: dict) -> pa.RecordBatch:
        anchors, own, of, window, low, high = (np.frombuffer(r[c], np.int64) for c in ("anchors", "own", "of", "windows", "low", "high"))
        ids, rows, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "rows", "labels"))
        score = products(matrix(r["vectors"], len(anchors), width), matrix(r["block_vectors"], len(ids), width))[of]
        fits = (labels[None, :] == own[of][:, None]) == same
        fits &= (rows[None, :] != anchors[of][:, None]) & (score >= low[:, None]) & (score <= high[:, None])
        if len(ids) > k and len(of):  # of a window's row, what is below the kth best comes too late
            best = np.where(fits, score, LOWEST)
            fits &= score >= np.partition(best, len(ids) - k, 1)[:, len(ids) - k][:, None]
        w, x = np.nonzero(fits)
        order = np.lexsort((rows[x], ids[x], -score[w, x], w))
        w, x = w[order], x[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        w, x = w[place < k], x[place < k]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (anchors[of[w]], window[w], score[w, x], ids[x], rows[x])], [f.split()[0] for f in HITS.split(", ")])

    return run


def beside(a: DataFrame, b: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """a joined with b, neither of them broadcast: blocks and packs of rows that are alike shrink so much on disk that they
    pass for small ones, and the driver would hold them whole.
    """
    return a.hint("merge").join(b.hint("merge"), key, how)


def best(hits: DataFrame, k: int) -> DataFrame:
    """HITS with rank: the k best of each window."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def searched(anchors: DataFrame, blocks: DataFrame, directory: Directory, k: int, same: bool, width: int) -> DataFrame:
    """HITS with rank: for each window (window, low, high) of anchors (anchor, label, vector, windows) its k best rows, of
    the anchor's label or of others.
    """
    at = blocks.select("block", "ids", "rows", "labels", F.col("vectors").alias("block_vectors"))

    def pass_(of: DataFrame, first: bool) -> DataFrame:
        packs = of.select("anchor", "label", "vector", "windows").mapInArrow(visits(directory, first, width), PACKS).withColumnRenamed("labels", "own")
        return beside(packs, at, "block").drop("block").mapInArrow(scored(k, same, width), HITS)

    none = lambda x: F.struct(x["window"].alias("window"), x["low"].alias("low"), x["high"].alias("high"), F.lit(LOWEST).alias("floor"))
    early = stored(best(pass_(anchors.withColumn("windows", F.transform("windows", none)), True), k))
    floors = early.filter(F.col("rank") == k).select("anchor", F.struct("window", "score").alias("one")).groupBy("anchor").agg(F.map_from_entries(F.collect_list("one")).alias("floors"))
    raised = lambda x: F.struct(x["window"].alias("window"), x["low"].alias("low"), x["high"].alias("high"), F.coalesce(F.try_element_at("floors", x["window"]), F.lit(LOWEST)).alias("floor"))
    late = pass_(beside(anchors, floors, "anchor", "left").withColumn("windows", F.transform("windows", raised)), False)
    return stored(best(early.drop("rank").unionByName(late), k))


def hard_negatives(rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from rows (vec_id, embedding, label).

    Components are floor(256 * x), a score is the inner product of two rows; higher scores come first, then smaller vec_ids.
    Anchors are rows whose vec_id is divisible by anchor_every, an anchor's positives its first rows of the same label but
    itself. For each positive: the first rows of other labels with least_percent * positive_score <= 100 * negative_score
    <= most_percent * positive_score.

    Rows with a null vec_id, label or vector, or a component that is null or not finite, take no part; short vectors have
    zeros after their end. Rows that repeat a vec_id are rows of their own, each an anchor or a positive of its equals; an
    anchor without positives, and a positive without negatives, give no row. Components from 2**54 on are an error. An empty
    table gives none. Other columns are ignored.
    """
    spoilt = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = rows.select(F.col("vec_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = valid.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~spoilt)
    n, width = valid.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = max(1, width or 1)
    drawn = sampled(valid, F.col("id"), n, FIT_VALUES // width).select("embedding").mapInArrow(packed_rows(width), "vector binary").toArrow()["vector"]
    sample = np.concatenate([np.zeros((0, width), np.int16), *(matrix(v.as_py(), 1, width) for v in drawn)])
    centres = fitted(sample, int(min(MOST_LISTS, len(sample), max(1, n // LIST_ROWS))))
    own = valid.mapInArrow(assigned(centres, width), "id long, row long, label long, list int, distance double, vector binary")
    block = max(BLOCK, n // MOST_BLOCKS)
    blocks = stored(own.repartitionByRange("list", "distance", "id").sortWithinPartitions("list", "distance", "id").mapInArrow(packed_blocks(block, width), BLOCKS).withColumn("block", F.monotonically_increasing_id()))
    found = blocks.select("block", "list", "radius").toArrow()
    directory = Directory(centres, *(found[c].to_numpy() for c in ("block", "list", "radius")))
    anchors = stored(blocks.select("ids", "rows", "labels", "vectors").mapInArrow(anchors_of(anchor_every, width), "anchor long, id long, label long, vector binary"))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    near = searched(anchors.withColumn("windows", everything), blocks, directory, positives, True, width)
    least = F.ceil(F.col("score").cast("decimal(20, 0)") * least_percent / 100).cast("long")
    most = F.floor(F.col("score").cast("decimal(20, 0)") * most_percent / 100).cast("long")
    positive = F.struct(F.col("row").alias("window"), least.alias("low"), most.alias("high"))
    windows = near.groupBy("anchor").agg(F.collect_list(positive).alias("windows"))
    hard = searched(beside(anchors, windows, "anchor"), blocks, directory, negatives, False, width)
    pairs = near.select("anchor", F.col("row").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = beside(hard.select("anchor", "window", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), pairs, ["anchor", "window"])
    return beside(out, anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def anchors_of(every: int, width: int):
    """For mapInArrow over blocks: anchor (the row), id, label, vector of the rows whose id is divisible by `every`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, rows, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "rows", "labels"))
                x = matrix(r["vectors"], len(ids), width)
                who = np.flatnonzero(ids % every == 0)
                yield arrow([(int(rows[k]), int(ids[k]), int(labels[k]), x[k].tobytes()) for k in who.tolist()], "anchor long, id long, label long, vector binary")

    return run


def oracle() -> str:
    """The same in DuckDB's SQL: anchors against all rows."""
    return """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), score AS (
  SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT * FROM (SELECT anchor, id, s, row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) AS n FROM score WHERE same) WHERE n <= 5
), negative AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY c.s DESC, c.id) AS INTEGER) AS rank, c.id AS negative_id, p.s AS positive_score, c.s AS negative_score
  FROM positive p JOIN score c ON c.anchor = p.anchor AND NOT c.same AND 80 * p.s <= 100 * c.s AND c.s <= p.s
)
SELECT * FROM negative WHERE rank <= 5
"""
