"""Connected components of a graph of 64-bit nodes.

Each task first reduces its own edges to a spanning forest. Where the forests together have few edges, one task joins them.
Otherwise large-star and small-star steps alternate on the cluster until each edge leads from a node to its root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import cut, meet

#: Edges that one task joins: 16 bytes each, some times over.
IN_ONE_TASK = 1_000_000
#: Edges that a task holds before it reduces them.
HELD = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), ascending, and for each the least node that it is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        open_ = parent[x] != parent[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[parent]


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (a, b): edges from nodes to their roots within the task, a > b."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        node, root = roots(a, b)
        return node[node != root], root[node != root]

    for batch in batches:
        a, b = np.append(a, batch.column(0).to_numpy(zero_copy_only=False)), np.append(b, batch.column(1).to_numpy(zero_copy_only=False))
        if len(a) >= HELD:
            a, b = reduced()
            if 2 * len(a) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
    a, b = reduced()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over all edges (a, b): node, root."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    node, root = roots(*(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """For each node u of pairs (u, v), with m the least of u and its v: an edge (v, m) for each v, or each v > u."""
    least = cut(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree")))
    out = meet(pairs.filter("v > u") if larger_only else pairs, least, "u", "degree", pairs.count())
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger_only:
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """node, root: for each node of edges (a, b), but for those that have edges to themselves only, the least node that it
    is connected with. Both ways, the one for few edges and the one for many, give the same.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").mapInArrow(spanning, "a long, b long"))
    if edges.count() <= in_one_task:
        return cut(edges.repartition(1).mapInArrow(whole, "node long, root long"))
    mark = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both, True)
        edges = cut(star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
