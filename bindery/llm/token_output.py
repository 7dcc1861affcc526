"""Operator 9, token-id output: best-fit-decreasing packing with a segment tree over free capacities.

Documents longer than a sequence are split without loss. Pieces are taken in windows of bounded size, longest first; a
segment tree over capacities finds the fullest open sequence that still has room. Each row of the result is a row of a
packed id matrix with its cumulative segment lengths and position resets.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.tokens import END_ID, Encoder, default_path

LENGTH, WINDOW_TOKENS, CARRY = 2048, 4_000_000, 64
SCHEMA = "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, input_ids binary, ids_crc32 long"


class CapacityTree:
    """Open sequences by free capacity; a segment tree counts them, so the tightest fit is found in log(length) steps."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: dict[int, list] = {}

    def put(self, free: int, sequence: list) -> None:
        self.held.setdefault(free, []).append(sequence)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        k = free + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, need: int) -> tuple[int, list] | None:
        """Takes out a sequence with the least free capacity of `need` or more."""
        k = need + self.leaves
        while not self.count[k]:  # up to the first subtree on the right that has any
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
            if k & (k - 1) == 0:
                return None
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        free = k - self.leaves
        self._change(free, -1)
        return free, self.held[free].pop()

    def all(self) -> list[tuple[int, list]]:
        return [(free, s) for free, stack in sorted(self.held.items()) for s in stack]


def best_fit_decreasing(pieces: list[tuple], tree: CapacityTree, length: int) -> list[list]:
    """Puts pieces (doc_id, start, ids) into the tree's sequences or new ones; gives those that are full."""
    full = []
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        free, sequence = tree.tightest(len(piece[2])) or (length, [])
        sequence.append(piece)
        free -= len(piece[2])
        if free:
            tree.put(free, sequence)
        else:
            full.append(sequence)
    return full


def packed_ids(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, window_tokens: int = WINDOW_TOKENS, pad_id: int = END_ID) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, n_segments, doc_ids, starts (each segment's first token within its
    document), cu_seqlens (0, then the end of each segment), position_resets (where positions restart at 0), input_ids
    (length little-endian unsigned 16- or 32-bit ids, by the size of the vocabulary; padded with pad_id), ids_crc32 (of the
    unpadded ids as unsigned 32-bit).

    Null texts are empty: they give the end id alone. Repeated rows and null doc_ids are packed like others; no id is lost
    or doubled. Other columns are ignored; an empty table gives no sequence. Windows of window_tokens bound the memory.
    """
    path = tokenizer or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tree, pieces, waiting, done = Encoder(path), CapacityTree(length), [], 0, []
        next_id = TaskContext.get().partitionId() << 32
        kind = "<u2" if encoder.merges.n_vocab + len(encoder.added) < 65536 else "<u4"

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, done
            for at in range(0, len(done), 512):
                part = done[at : at + 512]
                ids = [np.concatenate([p[2] for p in s]) for s in part]
                cu = [np.concatenate([[0], np.cumsum([len(p[2]) for p in s])]).tolist() for s in part]
                padded = [np.concatenate([x, np.full(length - len(x), pad_id)]).astype(kind).tobytes() for x in ids]
                arrays = [
                    pa.array(range(next_id, next_id + len(part)), pa.int64()), pa.array([len(x) for x in ids], pa.int32()), pa.array([len(s) for s in part], pa.int32()),
                    pa.array([[p[0] for p in s] for s in part], pa.list_(pa.int64())), pa.array([[p[1] for p in s] for s in part], pa.list_(pa.int64())),
                    pa.array(cu, pa.list_(pa.int32())), pa.array([c[:-1] for c in cu], pa.list_(pa.int32())), pa.array(padded, pa.binary()),
                    pa.array([crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                ]
                next_id += len(part)
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])
            done = []

        def settle(last: bool) -> None:
            """Packs the window; sequences with little room left are closed, the others stay open for the next one."""
            nonlocal tree, pieces, waiting, done
            done += best_fit_decreasing(pieces, tree, length)
            kept = CapacityTree(length)
            for free, s in tree.all():
                if last or free < CARRY:
                    done.append(s)
                else:
                    kept.put(free, s)
            tree, pieces, waiting = kept, [], 0

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.document(text)
                for start in range(0, len(ids), length):
                    pieces.append((doc_id, start, ids[start : start + length]))
                waiting += len(ids)
                if waiting >= window_tokens:
                    settle(False)
                    yield from flush()
        settle(True)
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrices and their indexes as a Parquet table: a row of input_ids is a row of the matrix."""
    packed.write.mode("overwrite").parquet(path)
