"""Token ids of words under the tokenizer file with word ends, each distinct word encoded once.

The tokenizer drops white space and never joins across it, so the ids of a text are those of its
words in order. A distinct word is encoded once per Python worker. Words of ordinary characters
go to the library's BPE model directly, after lower-casing and the file's split pattern; all
others (control strings, rare scripts, other white space) to the library as they are.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from styloweave.llm.words import LOWER, Words, split

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# fixed value: the split pattern of the tokenizer file
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT_OR_BLANK = regex.compile(SPLIT + "| ")
ORDINARY = regex.compile(r"[!-~¡-įı-ɏ]+")
SLOTS = 600_000
ASCII_WORD = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
MARK = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() for b in range(256)])


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes that byte-level tokenizers use."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Keeps ids of at most `SLOTS` distinct words; then it starts afresh. Results don't depend on it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.at = np.zeros(1, np.int64)      # start of each slot's ids; the last is the end
        self.ids = np.zeros(0, np.uint32)

    def encode(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of these words, the ids of all of them in that order, and each one's number of ids."""
        plain = [i for i, w in enumerate(words) if ORDINARY.fullmatch(w) and "<|" not in w]
        other = [] if len(plain) == len(words) else sorted(set(range(len(words))) - set(plain))
        # pieces of all words at once; a blank piece ends each word
        pieces = SPLIT_OR_BLANK.findall(" ".join([words[i] for i in plain] + [""]).lower())
        blank = np.flatnonzero(np.array([p == " " for p in pieces], bool))
        sizes = np.diff(blank, prepend=-1) - 1
        mapped = " ".join(p for p in pieces if p != " ")
        if not mapped.isascii():
            mapped = " ".join(p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
                              for p in mapped.split(" "))
        ids = np.array(self.bare.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))  # the end of each piece
        at = cut[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
        rest = [e.ids for e in self.whole.encode_batch([words[i] for i in other], add_special_tokens=False)]
        return (plain + other, np.concatenate((ids, *(np.array(x, np.uint32) for x in rest))),
                np.concatenate((np.diff(at), np.array([len(x) for x in rest], np.int64))))

    def slots(self, words) -> np.ndarray:
        """For each word of a block, the slot whose ids are its own."""
        hashes = words.hashes()
        distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slot) > SLOTS:
            self.clear()
        get = self.slot.get
        known = np.array([get(h, -1) for h in distinct.tolist()], np.int64)
        fresh = np.flatnonzero(known < 0)
        for a in range(0, len(fresh), 5000):
            part = fresh[a:a + 5000]
            order, ids, sizes = self.encode(words.texts(sample[part]))
            part, n = part[order], len(self.at) - 1
            known[part] = np.arange(n, n + len(part))
            self.slot.update(zip(distinct[part].tolist(), range(n, n + len(part))))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, ids))
        return known[inverse]

    def counts(self, words) -> np.ndarray:
        """Number of tokens of each row of a block of words."""
        slot = self.slots(words) if len(words.start) else np.zeros(0, np.int64)
        sizes = np.diff(self.at)[slot]
        total = np.concatenate(([0], np.cumsum(sizes)))
        return total[words.first[1:]] - total[words.first[:-1]]

    def rows(self, words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block and the offset of each row in them."""
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(words.n_rows + 1, np.int64)
        slot = self.slots(words)
        sizes = np.diff(self.at)[slot]
        total = np.concatenate(([0], np.cumsum(sizes)))
        source = np.arange(total[-1]) + np.repeat(self.at[slot] - total[:-1], sizes)
        return self.ids[source], total[words.first]


def units(column: pa.Array) -> Words:
    """The words of a text column in lower case, marks at their ends as words of their own.

    Case doesn't matter to this tokenizer, and its split pattern parts a letter or digit from the
    marks that end a word. Blocks with a control string keep case and words as they are.
    """
    plain = split(column)
    if b"<|" in plain.data.tobytes():
        return plain
    data = LOWER[plain.data]
    if not len(plain.start):
        return plain
    last = np.maximum.accumulate(np.where(MARK[data], -1, np.arange(len(data))))
    body = last[plain.end - 1] + 1
    tail = (body < plain.end) & (body > plain.start)
    final, before = data[body - 1], data[np.maximum(body - 2, 0)]
    # a letter or digit: of ASCII, or of the block that starts at U+00C0
    tail &= ASCII_WORD[final] | ((before == 0xC3) & (final >= 0x80) & (final != 0x97) & (final != 0xB7))
    start = np.concatenate((plain.start, body[tail]))
    end = np.concatenate((np.where(tail, body, plain.end), plain.end[tail]))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    first = np.searchsorted(start, plain.bounds, "left")
    row = np.repeat(np.arange(plain.n_rows), np.diff(first))
    return Words(data, plain.bounds, start, end, row, first)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file; it lives on from task to task."""
    return WordEncoder(path)
