"""Cost-balanced packing of documents into training sequences.

A document of ``n`` ids costs ``linear * n + quadratic * n * n`` in attention. Within a window, documents go in descending
length to the sequence of the lowest cost that still has room for them; what fits nowhere whole is cut, so every
sequence is full. A task packs its partition window by window and carries what is left to the next one, so
nothing is shuffled, memory is bounded by the window, and a lost task is repeated alone. At the end of a partition
the rest goes to sequences whose lengths are powers of two, which need no padding.

Defined cases: a null or empty text is one end id; repeated rows are separate documents; a null id stays null; ties
go by arrival, so the result is fixed for a fixed input partitioning; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from postura.llm.common import by_value, column, small_batches, text_of
from postura.llm.tokens import byte_bpe

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")
END = np.asarray([1], dtype="<u4").tobytes()
#: Ids that a task holds while it packs them.
WINDOW = 1 << 20


class Piece:
    """A run of ids of one document."""

    __slots__ = ("doc", "start", "total", "ids")

    def __init__(self, doc, start: int, total: int, ids: memoryview):
        self.doc, self.start, self.total, self.ids = doc, start, total, ids

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.total, self.ids[:4 * n]),
                Piece(self.doc, self.start + n, self.total, self.ids[4 * n:]))


def assign(pieces: list[Piece], rooms: list[int], linear: float, quadratic: float,
           ) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill sequences of the given rooms; returns their pieces, and the pieces left when all are full."""
    free, cost = np.asarray(rooms, dtype=np.int64), np.zeros(len(rooms))
    bins: list[list[Piece]] = [[] for _ in rooms]
    left: list[Piece] = []

    def put(piece: Piece, at: int) -> None:
        bins[at].append(piece)
        free[at] -= len(piece)
        cost[at] += linear * len(piece) + quadratic * len(piece) ** 2

    for piece in sorted(pieces, key=len, reverse=True):
        while len(piece):
            fits = free >= len(piece)
            if fits.any():
                put(piece, int(np.argmin(np.where(fits, cost, np.inf))))
                break
            most = int(free.max(initial=0))
            if not most:
                left.append(piece)
                break
            head, piece = piece.cut(most)
            put(head, int(np.argmin(np.where(free == most, cost, np.inf))))
    return bins, left


def powers(n: int) -> list[int]:
    """n as a sum of different powers of two."""
    return [1 << b for b in range(n.bit_length()) if n >> b & 1]


def pack_partition(documents: Iterable[tuple[object, bytes]], capacity: int, linear: float, quadratic: float,
                   window: int = WINDOW) -> Iterator[list[list[Piece]]]:
    """Packs (id, ids) in their order; yields groups of full sequences."""
    held: list[Piece] = []
    size = 0
    for doc, ids in documents:
        piece = Piece(doc, 0, len(ids) // 4, memoryview(ids))
        held.append(piece)
        size += len(piece)
        if size >= window:
            bins, held = assign(held, [capacity] * (size // capacity), linear, quadratic)
            size = sum(map(len, held))
            yield bins
    rooms = [capacity] * (size // capacity) + [p for p in powers(size % capacity)]
    yield assign(held, rooms, linear, quadratic)[0]


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         linear: float = 1.0, quadratic: float = 1.0 / 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it starts in the document, which sequence holds it and where there.

    ``tokenizer`` is the path of a byte-level vocabulary, readable on every worker. ``with_ids`` adds the ids as a
    binary of little-endian unsigned 32-bit integers. Sequence ids are unique; offsets in a sequence have no gaps.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer).encode
        sequence = TaskContext.get().partitionId() << 40

        def documents():
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for doc, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                    yield doc, ids + END

        for bins in pack_partition(documents(), capacity, linear, quadratic):
            out: list[list] = [[] for _ in range(9)]
            for pieces in bins:
                offset, full = 0, sum(map(len, pieces))
                for p in pieces:
                    row = (p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, sequence, offset, full,
                           bytes(p.ids) if with_ids else None)
                    for values, value in zip(out, row):
                        values.append(value)
                    offset += len(p)
                sequence += 1
            types = [pa.int64()] * 8 + [pa.binary()]
            columns = [pa.array(v, t) for v, t in zip(out, types)][:9 if with_ids else 8]
            yield pa.RecordBatch.from_arrays(columns, names[:len(columns)])

    schema = SCHEMA + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return df.select(column(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


by_value(__name__)
