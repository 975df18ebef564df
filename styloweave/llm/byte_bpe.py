"""Token ids of whole texts under a byte-level tokenizer file, each distinct unit encoded once.

The file's split pattern never joins a letter or digit with a mark or white space that follows it,
nor white space with a letter or mark before it, so a text may be cut there and the units encoded
apart. A distinct unit is encoded once per Python worker, by the library; other places are not cut,
so their units are only longer. A file with other rules is not cut at all: its units are whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from styloweave.llm.bpe import WordEncoder
from styloweave.llm.words import Words, buffers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_BYTES = range(256)
_BLANK = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in _BYTES])
_WORD = np.array([chr(b).isascii() and chr(b).isalnum() for b in _BYTES])
_MARK = np.array([0x21 <= b < 0x7F and not _WORD[b] for b in _BYTES])
_TAIL = np.array([0x80 <= b < 0xC0 for b in _BYTES])
_LATIN = np.array([0xC3 <= b <= 0xC9 for b in _BYTES])  # first bytes of U+00C0 to U+024F
_SIGNS = (0x97, 0xB7)  # second bytes of the two signs among them


class Units(Words):
    """Units of a block of rows; unlike words they hold blanks, and cover every byte."""

    def texts(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8") for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


def units(column: pa.Array, cut: bool = True) -> Units:
    data, bounds = buffers(column)
    n = len(data)
    at = np.zeros(n + 1, bool)
    at[bounds] = True
    if cut and n > 1:
        before2 = np.concatenate(([0], data[:-2])) if n > 2 else np.zeros(n - 1, np.uint8)
        before, here = data[:-1], data[1:]
        latin = _TAIL[before] & _LATIN[before2]
        letter = _WORD[before] | (latin & ~((before2 == 0xC3) & np.isin(before, _SIGNS)))
        # before white space that follows a mark, letter or digit; bytes of other scripts are left alone
        at[1:-1] |= _BLANK[here] & (_MARK[before] | _WORD[before] | latin)
        # behind a line end alone between two such
        after = _MARK[here] | _WORD[here] | _LATIN[here]
        at[2:-1] |= (before[1:] == 0x0A) & after[1:] & at[1:-2]
        if b"<|" not in data.tobytes():  # a control string must stay in one unit
            at[1:-1] |= letter & _MARK[here]
            at[1:-1] |= _MARK[before] & (before != 0x27) & _WORD[here]
    cuts = np.flatnonzero(at)
    start, end = cuts[:-1], cuts[1:]
    first = np.searchsorted(start, bounds, "left")
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Units(data, bounds, start, end, row, first)


class ByteEncoder(WordEncoder):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        file = json.loads(self.whole.to_str())
        rule = file["pre_tokenizer"] or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].startswith("<|")
                    and not any(c.isspace() for c in t["content"]) for t in file["added_tokens"])
        # known rules only: the byte-level split, no normaliser, control strings that begin with <|
        self.cuts = file["normalizer"] is None and plain and rule.get("type") == "ByteLevel" \
            and rule.get("use_regex", True) and not rule.get("add_prefix_space", True)
        self.clear()

    def encode(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        return list(range(len(words))), flat, sizes

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column and the offset of each row in them; null counts as empty."""
        return self.rows(units(column, self.cuts))


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One encoder per worker and file; it lives on from task to task."""
    return ByteEncoder(path)
