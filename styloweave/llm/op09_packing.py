"""Harmonic packing of token ids into sequences of a fixed capacity.

A harmonic packer sorts pieces into classes of reciprocal capacity and fills each bin of class k
with exactly k pieces. Documents may be cut here, so each one is cut into pieces whose lengths are
exact reciprocals of the capacity (capacity / 1, / 2, / 4, ...): full pieces first, then the binary
parts of the rest from long to short. A bin of class k then holds k pieces and no padding. What a
worker has left in a class is closed as bins of 2^a pieces, whose length is a power of two, so they
need no padding either. Workers are the partitions of the input: each one fills its own bins, so
nothing is shuffled, and only the open bins (under two capacities of pieces) are held.

A lost task packs its partition again to the same rows, as its input is a fixed split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm import bpe
from styloweave.llm.words import blocks

CAPACITY = 2_048
END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `n` ids."""
    out = [(at, capacity) for at in range(0, n - n % capacity, capacity)]
    at, rest = n - n % capacity, n % capacity
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


class Bins:
    """Open bins of one worker, by piece length."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.open = capacity, {}
        self.next = worker << 36

    def close(self, size: int, count: int) -> list[tuple]:
        """Take the first `count` pieces of a class as one sequence."""
        held = self.open[size]
        out = [(*p, self.next, i * size) for i, p in enumerate(held[:count])]
        self.open[size] = held[count:]
        self.next += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        size = piece[2]
        held = self.open.setdefault(size, [])
        held.append(piece)
        full = self.capacity // size
        return self.close(size, full) if len(held) == full else []

    def finish(self) -> Iterator[tuple]:
        for size in sorted(self.open, reverse=True):
            while held := self.open[size]:
                yield from self.close(size, 1 << (len(held).bit_length() - 1))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then `end_id`; a null or empty text is that id alone. Null
    ids stay null, repeated rows are packed each, other columns are not carried. `with_ids` adds
    the piece's ids (`ids`, array of int). `capacity` must be a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins, out = bpe.encoder(path), Bins(TaskContext.get().partitionId(), capacity), []

        def put(row: tuple) -> None:
            doc, start, length, crc, total, ids, sequence, offset = row
            out.append((doc, start, length, crc, total, sequence, offset, *([ids] if with_ids else [])))

        for block in blocks(batches):
            ids, at = coder.rows(bpe.units(block.column(1)))
            raw = ids.astype("<u4")
            for r, doc in enumerate(block.column(0).to_pylist()):
                own = raw[at[r]:at[r + 1]]
                own = memoryview(own.tobytes() + end_id.to_bytes(4, "little"))
                total = len(own) // 4
                for start, size in pieces(total, capacity):
                    part = own[4 * start:4 * (start + size)]
                    held = list(part.cast("I")) if with_ids else None
                    for row in bins.add((doc, start, size, zlib.crc32(part), total, held)):
                        put(row)
            if len(out) >= 20_000:
                yield batch(out)
                out.clear()
        for row in bins.finish():
            put(row)
        if out:
            yield batch(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(fill, schema)
