"""Best-fit packing of whole documents by a configuration linear program.

A document of at most one capacity stays whole; a longer one is cut into full pieces, the first one
shorter. Of all pieces only the histogram of lengths reaches the driver, at most `capacity` numbers
whatever the input. A configuration is a multiset of lengths that fits a sequence. The program,
fewest configurations that cover the histogram, is solved by multiplicative weights: each length
has a weight that falls as it is covered; a knapsack dynamic program over the capacity prices the
best configuration with each length at once; all that come near the best get a step. Most of the
solution is taken, rounded down, the rest is solved again, and what then remains is placed by best
fit. Each round also gives a lower bound of the program (total weight over best
price).

Pieces are then numbered within their length: within a task as they are read, across tasks by
running sums of counts, so a length that a third of all pieces share is not gathered. The plan maps
(length, number) to sequence and offset by intervals; it has as many intervals as configurations
have lengths, and goes out to the tasks. Neither texts nor ids are shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from styloweave.llm import byte_bpe
from styloweave.llm.storage import stored
from styloweave.llm.words import blocks
from styloweave.session import broadcast_if_small

CAPACITY = 1_024
END_ID = 2
ROUNDS = 100        # of multiplicative weights, for each of PASSES programs
PASSES = 6
STEP = 0.1          # share of a length's pieces that one round may cover
NEAR = 0.01         # configurations this near to the best price get a step
SHARE = 0.8         # of a solution that is taken; what is left is solved again
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass
class Plan:
    """Sequences as (configuration, copies); a configuration is a tuple of (length, count)."""

    sequences: list[tuple[tuple[tuple[int, int], ...], int]]
    lower_bound: float   # of the fewest sequences

    @property
    def n_sequences(self) -> int:
        return sum(copies for _, copies in self.sequences)


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to `capacity`, the best total price of lengths that fit, and the index last put in."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            value = prices[:fits[room]] + best[room - lengths[:fits[room]]]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], last[room] = value[k], k
    return best, last


def trace(room: int, first: int, last: np.ndarray, lengths: np.ndarray) -> tuple[tuple[int, int], ...]:
    """The configuration (index, count) of length `first` and the best filling of what it leaves of `room`."""
    held = Counter({first: 1})
    room -= int(lengths[first])
    while room > 0:
        if (k := int(last[room])) < 0:
            room -= 1
        else:
            held[k] += 1
            room -= int(lengths[k])
    return tuple(sorted(held.items()))


def relaxed(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[dict, float]:
    """Configurations with fractional copies that cover about all counts, and a lower bound of their least sum."""
    n = counts.astype(float)
    log_weight = np.log(n * lengths)      # at first, a piece is worth its length
    copies: dict[tuple, float] = {}
    covered, bound = np.zeros(len(n)), 0.0
    for _ in range(rounds):
        weight = np.exp(log_weight - log_weight.max())
        prices = weight / n
        best, last = knapsack(prices, lengths, capacity)
        bound = max(bound, weight.sum() / best[capacity])
        value = prices + best[capacity - lengths]
        chosen = {trace(capacity, int(k), last, lengths) for k in np.flatnonzero(value >= (1 - NEAR) * best[capacity])}
        used = np.zeros(len(n))
        for config in chosen:
            for k, a in config:
                used[k] += a
        for config in sorted(chosen):
            step = min(STEP * n[k] / used[k] for k, _ in config)
            copies[config] = copies.get(config, 0.0) + step
            for k, a in config:
                covered[k] += step * a / n[k]
                log_weight[k] -= step * a / n[k]
        if covered.min() >= 8:
            break
    scale = 1 / max(np.average(covered, weights=n * lengths), 1e-9)
    return {c: x * scale for c, x in copies.items()}, bound


def best_fit(items: list[int], capacity: int) -> list[Counter]:
    """Longest first, each into the fullest bin that has room."""
    bins: list[Counter] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for size in sorted(items, reverse=True):
        room = next((r for r in range(size, capacity + 1) if by_room[r]), None)
        if room is None:
            bins.append(Counter())
            at, room = len(bins) - 1, capacity
        else:
            at = by_room[room].pop()
        bins[at][size] += 1
        by_room[room - size].append(at)
    return bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Few sequences for a histogram of lengths; full pieces have sequences of their own."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    bins: Counter = Counter()
    if left[capacity]:
        bins[((capacity, 1),)] = int(left[capacity])
    full, left[capacity] = int(left[capacity]), 0
    bound = None

    def take(config: tuple, lengths: np.ndarray, wanted: int) -> None:
        k = min(wanted, *(int(left[lengths[i]]) // a for i, a in config)) if wanted > 0 else 0
        if k > 0:
            bins[tuple((int(lengths[i]), a) for i, a in config)] += k
            for i, a in config:
                left[lengths[i]] -= a * k

    for _ in range(PASSES):
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        before = int(left.sum())
        found, lower = relaxed(lengths, left[lengths], capacity, rounds)
        bound = lower if bound is None else bound
        waste = {c: capacity - sum(int(lengths[i]) * a for i, a in c) for c in found}
        for c in sorted(found, key=lambda c: (waste[c], -found[c], c)):
            take(c, lengths, int(SHARE * found[c]))
        if int(left.sum()) == before:
            break
    rest = [int(k) for k in np.flatnonzero(left) for _ in range(int(left[k]))]
    for one in best_fit(rest, capacity):
        bins[tuple(sorted(one.items()))] += 1
    return Plan(sorted(bins.items()), full + (bound or 0.0))


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int,
           with_ids: bool) -> DataFrame:
    """One row per piece, with the task (`part`) that made it and its number among equal lengths there."""
    schema = PIECE + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] \
        + [pa.list_(pa.int32())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = byte_bpe.encoder(path), TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")
        for block in blocks(batches):
            ids, at = coder.of(block.column(1))
            raw, out = ids.astype("<u4"), []
            for r, doc in enumerate(block.column(0).to_pylist()):
                own = memoryview(raw[at[r]:at[r + 1]].tobytes() + end)
                total = len(own) // 4
                first = total % capacity or capacity
                for k, start in enumerate([0, *range(first, total, capacity)]):
                    size = first if not k else capacity
                    held = own[4 * start:4 * (start + size)]
                    out.append((doc, k, start, size, zlib.crc32(held), part, seen[size],
                                *([list(held.cast("I"))] if with_ids else [])))
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(cut, schema)


def intervals(made: Plan) -> np.ndarray:
    """(length, first number, first sequence, pieces of it in each sequence, offset of the first), sorted."""
    taken, out, sequence = Counter(), [], 0
    for config, copies in made.sequences:
        offset = 0
        for length, count in config:
            out.append((length, taken[length], sequence, count, offset))
            taken[length] += copies * count
            offset += length * count
        sequence += copies
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False, plans: list[Plan] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then `end_id`; a null or empty text is that id alone. Null ids
    stay null, repeated rows are packed each, other columns are not carried, whatever their names. An empty table gives no rows.
    `with_ids` adds the piece's ids (`ids`, array of int). A list `plans` gets the plan.
    """
    rows = stored(pieces(docs, path, id_col, text_col, capacity, end_id, with_ids))
    counts = stored(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity)
    if plans is not None:
        plans.append(made)
    line = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("first"))
    numbered = rows.join(broadcast_if_small(first), ["part", "length"]) \
        .withColumn("number", F.col("first") + F.col("nth"))
    table = intervals(made)
    extra = ["ids"] if with_ids else []
    keys = table[:, 0] << 44 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(keys, length << 44 | number, "right") - 1
            _, low, sequence, count, offset = table[at].T
            across, inside = np.divmod(number - low, count)
            placed = {"sequence_id": pa.array(sequence + across), "offset": pa.array(offset + inside * length)}
            names = [c.split()[0] for c in PLACED.split(", ")] + extra
            yield pa.RecordBatch.from_arrays(
                [placed[c] if c in placed else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number", *extra) \
        .mapInArrow(place, PLACED + (", ids array<int>" if with_ids else ""))
