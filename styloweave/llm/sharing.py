"""Which (document, hash) pairs share their hash with another document, without hot groups.

Each task first compares the pairs it has itself and sends on one row a hash, however many
documents hold it. A hash that is everywhere so becomes as many rows as there are blocks of
`FLUSH` pairs, never one for each document or pair of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm.words import mix

FLUSH = 2_000_000
PAIRS = "part long, hash long, doc_id long, known boolean, many boolean"


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def _local(hashes: np.ndarray, docs: np.ndarray, smaller: bool) -> list[pa.RecordBatch]:
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])))
    hashes, docs = hashes[fresh], docs[fresh]
    start = _starts(hashes)
    size = np.diff(np.append(start, len(hashes)))
    first = np.zeros(len(hashes), bool)
    first[start] = True
    known = ~first if smaller else np.repeat(size > 1, size)
    pair = mix(hashes[known] ^ mix(docs[known].astype(np.uint64)))
    out = []
    for part, h, d, k, many in (
            (pair, hashes[known], docs[known], True, np.zeros(int(known.sum()), bool)),
            (hashes[start], hashes[start], docs[start], False, size > 1)):
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(part.view(np.int64)), pa.array(h.view(np.int64)), pa.array(d),
             pa.array(np.full(len(d), k)), pa.array(many)], names=["part", "hash", "doc_id", "known", "many"]))
    return out


def _decide(smaller: bool):
    """Over rows sorted by hash, the pairs whose hash another (a smaller) document has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None

        def settled(rows: pa.Table) -> pa.RecordBatch:
            h, d, known, many = (rows.column(i).to_numpy() for i in range(1, 5))
            known, many = known.astype(bool), many.astype(bool)
            keep = known.copy()
            if (~known).any():
                at = np.flatnonzero(~known)
                own, docs = h[at], d[at]
                start = _starts(own)
                size = np.diff(np.append(start, len(own)))
                least = np.repeat(np.minimum.reduceat(docs, start), size)
                if smaller:
                    keep[at] = docs > least
                else:
                    most = np.repeat(np.maximum.reduceat(docs, start), size)
                    several = np.repeat(np.logical_or.reduceat(many[at], start), size)
                    keep[at] = (several | (most > least)) & ~many[at]
            return pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(h[keep])], names=["doc_id", "hash"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if carried is not None:
                rows = pa.concat_tables([carried, rows]).combine_chunks()
            part = rows.column(0).to_numpy()
            cut = int(np.searchsorted(part, part[-1], "left")) if len(part) else 0
            if cut:
                yield settled(rows.slice(0, cut))
            carried = rows.slice(cut)
        if carried is not None and carried.num_rows:
            yield settled(carried)
    return run


def shared_pairs(rows: DataFrame, hashes_of: Callable, smaller: bool) -> DataFrame:
    """(doc_id, hash) whose hash some other document has too, or with `smaller` one of smaller id.

    `hashes_of(batch)` gives the hashes of a batch of `rows` and the document of each. What two
    documents share is decided on 64-bit hashes.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for h, d in hashes_of(batch):
                held.append((h, d))
                n += len(h)
                if n >= FLUSH:
                    yield from _local(*map(np.concatenate, zip(*held)), smaller)
                    held, n = [], 0
        if n:
            yield from _local(*map(np.concatenate, zip(*held)), smaller)

    pairs = rows.mapInArrow(emit, PAIRS)
    return pairs.repartition(F.col("part")).sortWithinPartitions("part") \
        .mapInArrow(_decide(smaller), "doc_id long, hash long")
