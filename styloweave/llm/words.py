"""Words, word hashes and window hashes of Arrow text columns, as whole numpy arrays.

A word is a maximal run of bytes of a class. UTF-8 bytes of other than ASCII characters are all
0x80 or more, so ASCII-defined classes can be told byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

SPACES = (0x20, *range(0x09, 0x0E))
U64 = np.uint64
# random odd 64-bit constants; any would do
BASE, STEP = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)


def _byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: `[^\x20\x09-\x0D]+`
PLAIN = _byte_class(lambda b: b not in SPACES)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of lower-cased text
ALNUM = _byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_BYTE_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of a block of rows, in order. `first[r]:first[r + 1]` are the words of row `r`."""

    data: np.ndarray     # all bytes
    bounds: np.ndarray   # byte offsets of rows, one more than rows
    start: np.ndarray    # byte offset of each word
    end: np.ndarray
    row: np.ndarray      # row of each word
    first: np.ndarray    # word offsets of rows, one more than rows

    @property
    def n_rows(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self, which: np.ndarray) -> list[str]:
        """These words, which must hold no blank."""
        start, size = self.start[which], (self.end - self.start)[which] + 1
        at = np.cumsum(size)
        source = np.arange(at[-1] if len(at) else 0) + np.repeat(start - (at - size), size)
        out = self.data[np.minimum(source, len(self.data) - 1)]
        out[at - 1] = 0x20
        return out.tobytes().decode("utf-8", "replace").split(" ")[:-1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.start)
        if not n:
            return np.zeros(0, U64)
        size = self.end - self.start
        offset = np.concatenate(([0], np.cumsum(size)))
        inside = np.arange(offset[-1]) - np.repeat(offset[:-1], size)
        powers = _powers(BASE, int(size.max()))
        terms = _BYTE_VALUE[self.data[inside + np.repeat(self.start, size)]] * powers[inside]
        return mix(np.add.reduceat(terms, offset[:-1]) ^ (size.astype(U64) * STEP))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def split(column: pa.Array, kind: np.ndarray = PLAIN, lower: bool = False) -> Words:
    data, bounds = buffers(column)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, bounds, "left")
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(data, bounds, start, end, row, first)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each `length` consecutive values; a window is valid only inside one row."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, step, run = np.zeros(n, U64), 0, 1, hashes
    scales = _powers(BASE, length + 1)
    left = length
    while left:
        if left & 1:
            out += run[done:done + n] * scales[done]
            done += step
        left >>= 1
        if left:
            run = run[:len(run) - step] + run[step:] * scales[step]
            step *= 2
    return mix(out)


def window_rows(words: Words, length: int) -> np.ndarray:
    """Which windows of `length` words lie inside one row."""
    n = max(len(words.row) - length + 1, 0)
    return words.row[:n] == words.row[length - 1:length - 1 + n]


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of column `text` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum([0, *(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)
                               .to_numpy(zero_copy_only=False))])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
