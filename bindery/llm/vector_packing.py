"""Operator 5, packing: vector bin packing by the dot-product heuristic, within each partition, without a shuffle.

A sequence has three limits: tokens, segments and loss-bearing tokens. Of a bounded pool of waiting pieces, the one goes
next into the open sequence whose needs, as shares of the limits, have the largest dot product with what is left of them.
Where none fits whole, one is cut. A sequence that can't be filled ends at a power of two of tokens, and what is beyond
waits again, so nothing is padded.

Instruction data come from conversations: a segment is an answer with the turns that ask for it, which bear no loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.tokens import Encoder, default_path

CAPACITY, SEGMENTS, LOSS, POOL = 2048, 1024, 2048, 512
#: Of instruction data, as many tokens of a sequence bear loss at most.
ANSWERS = 1536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, part long"


class Piece(NamedTuple):
    """Tokens of a document from `start` on, of which those from loss_from on (counted in the document) bear loss."""

    doc_id: int | None
    part: int | None
    ids: np.ndarray
    start: int
    doc_tokens: int
    loss_from: int

    def bearing(self, n: int) -> int:
        """How many of the first n tokens bear loss."""
        return max(0, self.start + n - max(self.start, self.loss_from))

    def after(self, n: int) -> Piece:
        return self._replace(ids=self.ids[n:], start=self.start + n)


class Packer:
    """Takes documents, gives rows of SCHEMA as sequences close. About `pool` pieces wait at a time."""

    def __init__(self, sequence_id: int, capacity: int, segments: int, loss: int, pool: int) -> None:
        self.capacity, self.segments, self.loss = capacity, segments, loss
        self.next_id, self.pool = sequence_id, pool
        self.waiting: list[Piece] = []
        self.tokens, self.losses = np.zeros(2 * pool), np.zeros(2 * pool)  # of the waiting pieces
        self.rows: list[tuple] = []

    def put(self, piece: Piece) -> None:
        k = len(self.waiting)
        if k == len(self.tokens):
            self.tokens, self.losses = np.append(self.tokens, np.zeros(k)), np.append(self.losses, np.zeros(k))
        self.waiting.append(piece)
        self.tokens[k], self.losses[k] = len(piece.ids), piece.bearing(len(piece.ids))

    def take(self, k: int) -> Piece:
        piece, last = self.waiting[k], self.waiting.pop()
        if k < len(self.waiting):
            self.waiting[k] = last
            self.tokens[k], self.losses[k] = self.tokens[len(self.waiting)], self.losses[len(self.waiting)]
        return piece

    def add(self, doc_id: int | None, ids: np.ndarray, loss_from: int = 0, part: int | None = None) -> None:
        piece = Piece(doc_id, part, ids, 0, len(ids), loss_from)
        while len(piece.ids) >= self.capacity:  # a sequence of its own
            piece = self.close([(piece, min(self.capacity, max(0, loss_from - piece.start) + self.loss))])[0]
        if len(piece.ids):
            self.put(piece)
            while len(self.waiting) >= self.pool:
                self.fill()

    def choice(self, tokens: float, segments: float, loss: float) -> tuple[int, int]:
        """The piece that goes next where so much is left, and how many of its tokens."""
        need, bear = self.tokens[: len(self.waiting)], self.losses[: len(self.waiting)]
        fits = (need <= tokens) & (bear <= loss)
        if segments > 1 and fits.any():
            # every piece needs one segment, so that term of the product is the same for all
            k = int(np.where(fits, need * (tokens / self.capacity**2) + bear * (loss / self.loss**2), -1.0).argmax())
            return k, int(need[k])
        longest = np.minimum(np.minimum(need, tokens), need - bear + loss)
        return (k := int(longest.argmax())), int(longest[k])

    def fill(self) -> None:
        """Fills and closes one sequence from the pool."""
        tokens, segments, loss = self.capacity, self.segments, self.loss
        placed: list[tuple[Piece, int]] = []
        while self.waiting and tokens and segments:
            k, n = self.choice(tokens, segments, loss)
            if not n:
                break
            piece = self.take(k)
            placed.append((piece, n))
            tokens, segments, loss = tokens - n, segments - 1, loss - piece.bearing(n)
        for piece in self.close(placed):
            if len(piece.ids):
                self.put(piece)

    def close(self, placed: list[tuple[Piece, int]]) -> list[Piece]:
        """Writes a sequence of (piece, tokens of it), if it isn't full up to a power of two; gives what the pieces have left."""
        total = sum(n for _, n in placed)
        room = total if total == self.capacity else 1 << (total.bit_length() - 1)
        offset, rest = 0, []
        for piece, n in placed:
            n = min(n, room - offset)
            if n:
                self.rows.append((piece.doc_id, piece.start, n, crc32(piece.ids[:n].tobytes()), piece.doc_tokens, self.next_id, offset, piece.bearing(n), piece.part))
                offset += n
            rest.append(piece.after(n))
        self.next_id += 1
        return rest

    def finish(self) -> None:
        while self.waiting:
            self.fill()


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = LOSS, prompt: str | None = None, pool: int = POOL, part: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, and part, if a column
    of docs is named that tells the documents of one doc_id apart.

    A document is the ids of its prompt (a column whose tokens bear no loss, if named), those of its text, and id 1; null
    texts and prompts are empty, so every row gives one token at least. Every id lies in exactly one piece. Repeated rows
    and null doc_ids are packed like others. Other columns are ignored; an empty table gives no piece. Very long texts are
    cut into sequences of their own as they come.
    """
    path = tokenizer or default_path()
    optional = [(F.col(prompt).cast("string") if prompt else F.lit(None).cast("string")).alias("prompt"), (F.col(part) if part else F.lit(None)).cast("long").alias("part")]
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *optional]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(path), Packer(TaskContext.get().partitionId() << 32, capacity, segments, loss, pool)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(names)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for b in batches:
            for doc_id, text, before, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head = encoder.ids(before) if before else np.zeros(0, "<u4")
                packer.add(doc_id, np.append(head, encoder.document(text)), len(head), of)
                if len(packer.rows) >= 20_000:
                    yield flush()
        packer.finish()
        yield flush()

    packed = docs.select(columns).mapInArrow(rows, SCHEMA)
    return packed if part else packed.drop("part")


def answers(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """doc_id (the conv_id), turn, prompt, text: each answer of a conversation, with the turns since the last answer before it
    as its prompt, joined by line feeds. Turns go by number, equal ones by role and text; turns that no answer follows are a
    prompt with an empty text. Null texts are empty; a null role asks.
    """
    answer = F.coalesce(F.col("role") == role, F.lit(False))
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    before = F.coalesce(F.sum(answer.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), answer.alias("answer"), F.coalesce("text", F.lit("")).alias("text"), before.alias("exchange"))
    asked = F.transform(F.sort_array(F.collect_list(F.when(~F.col("answer"), F.struct("turn", "text")))), lambda t: t["text"])
    return turns.groupBy("conv_id", "exchange").agg(F.max("turn").alias("turn"), F.array_join(asked, "\n").alias("prompt"), F.coalesce(F.max(F.when(F.col("answer"), F.col("text"))), F.lit("")).alias("text")).select(F.col("conv_id").cast("long").alias("doc_id"), "turn", "prompt", "text")


def pack_conversations(conversations: DataFrame, tokenizer: str | None = None, loss: int = ANSWERS) -> DataFrame:
    """The pieces (as pack gives them, with part: the answer's turn) of instruction data: of a conversation's tokens only
    those of answers bear loss, and a sequence has `loss` of them at most.
    """
    return pack(answers(conversations), tokenizer, loss=loss, prompt="prompt", part="turn")
