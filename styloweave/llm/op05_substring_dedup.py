"""Exact substring deduplication with difference-cover anchors.

The positions of a difference cover D modulo v have this property: for any two positions i and j
some shift below v brings both into the cover. So two equal windows of 50 words, wherever they
start, hold an equal stretch of 50 - v + 1 words that starts at a cover position in both. It is
enough to hash these anchors, a fifth of all positions. Documents that share an anchor are
candidates; there the anchors extend to all windows that hold them, which are hashed whole, and a
window that some document of smaller id has too is removed.

Whole copies are told by the digest of their words and go no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm.sharing import shared_pairs
from styloweave.llm.storage import stored
from styloweave.llm.words import blocks, split, window_rows, windows

WINDOW = 50
#: A perfect difference set modulo 31: every difference occurs once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BASE = "doc_id long, text_key long, n_words long, digest string"


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, text=2):
        words = [t.encode().split() if t else [] for t in block.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [block.column(0), block.column(1), pa.array([len(w) for w in words], pa.int64()),
             pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())],
            names=["doc_id", "text_key", "n_words", "digest"])


def _anchor_hashes(words, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors of a block, and the word at which each starts."""
    length = window - period + 1
    inside = window_rows(words, length)
    at = np.arange(len(inside))
    row = words.row[:len(inside)]
    place = at - words.first[row]
    good = inside & (words.counts()[row] >= window) & np.isin(place % period, cover)
    return windows(words.hashes(), length)[good], at[good]


def _candidates(window: int, period: int, cover: tuple[int, ...]):
    """Windows that hold a shared anchor, as ranges [a, b) of first words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = split(block.column(1))
            hashes, at = _anchor_hashes(words, window, period, cover)
            shared = block.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(len(block)), np.diff(block.column(2).offsets.to_numpy()))
            row = words.row[at]
            hit = np.zeros(len(at), bool)
            order = np.argsort(row, kind="stable")
            bounds = np.searchsorted(row[order], np.arange(len(block) + 1))
            owners = np.searchsorted(owner, np.arange(len(block) + 1))
            for r in range(len(block)):
                a, b = bounds[r], bounds[r + 1]
                hit[a:b] = np.isin(hashes[a:b], shared[owners[r]:owners[r + 1]])
            at, row = at[hit], row[hit]
            # anchor at p: windows that start from p - (period - 1) to p
            first, last = words.first[row], words.first[row + 1] - window
            low, high = np.maximum(at - period + 1, first), np.minimum(at, last)
            delta = np.zeros(len(words.row) + 2, np.int64)
            np.add.at(delta, low, 1)
            np.add.at(delta, high + 1, -1)
            chosen = np.cumsum(delta)[:len(words.row)] > 0
            ranges = _ranges(chosen, words)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), ranges],
                                             names=["doc_id", "text", "ranges"])
    return run


def _ranges(chosen: np.ndarray, words) -> pa.Array:
    """Per row, the runs of chosen words as a flat list a, b, a, b ... of word numbers in the row."""
    opens, closes = chosen.copy(), chosen.copy()
    if len(chosen):
        same = words.row[1:] == words.row[:-1]
        opens[1:] &= ~(chosen[:-1] & same)
        closes[:-1] &= ~(chosen[1:] & same)
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = words.row[a] if len(a) else np.zeros(0, np.int64)
    flat = np.stack([a - words.first[row], b - words.first[row]], 1).ravel()
    offsets = 2 * np.searchsorted(row, np.arange(words.n_rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _window_hashes(block: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, object]:
    """Hash and first word of each candidate window of a block with ranges."""
    words = split(block.column(1))
    flat = block.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    owner = np.repeat(np.arange(len(block)), np.diff(block.column(2).offsets.to_numpy()) // 2)
    start = words.first[owner] + flat[:, 0]
    size = (flat[:, 1] - flat[:, 0]).astype(np.int64)
    total = np.cumsum(size)
    at = np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)
    return windows(words.hashes(), window)[at], at, words


def _outcome(window: int):
    """Take the removed windows out: the digest of the kept words and the remaining text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes, at, words = _window_hashes(block, window)
            removed = block.column(3)
            gone = removed.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owners = np.searchsorted(np.repeat(np.arange(len(block)), np.diff(removed.offsets.to_numpy())),
                                     np.arange(len(block) + 1))
            bounds = np.searchsorted(words.row[at], np.arange(len(block) + 1))
            delta = np.zeros(len(words.row) + 1, np.int64)
            for r in range(len(block)):
                a, b = bounds[r], bounds[r + 1]
                hit = at[a:b][np.isin(hashes[a:b], gone[owners[r]:owners[r + 1]])]
                np.add.at(delta, hit, 1)
                np.add.at(delta, hit + window, -1)
            covered = np.cumsum(delta)[:-1] > 0
            n_removed, digests, texts = [], [], []
            for r in range(len(block)):
                first, last = int(words.first[r]), int(words.first[r + 1])
                own = covered[first:last]
                kept = np.flatnonzero(~own) + first
                n_removed.append(int(own.sum()))
                whole, base = words.data[words.bounds[r]:words.bounds[r + 1]].tobytes(), int(words.bounds[r])
                spans = [whole[s - base:e - base]
                         for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist())]
                digests.append(hashlib.sha256(b" ".join(spans)).hexdigest())
                # the remaining text keeps the white space after each kept word
                parts, edge = [], 0
                flips = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                for a, b in zip(flips[::2].tolist(), flips[1::2].tolist()):
                    parts.append(whole[edge:int(words.start[first + a]) - base])
                    edge = int(words.start[first + b]) - base if first + b < last else len(whole)
                texts.append((b"".join(parts) + whole[edge:]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()),
                 block.column(4), pa.array(texts, pa.string())],
                names=["doc_id", "n_removed", "kept_sha256", "text_key", "kept_text"])
    return run


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
             period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, text_key, kept_text.

    kept_text is null where nothing is removed. A word goes when a window of `window` words over it also starts
    in a document of smaller id; windows are judged on the input. Null texts have no words. Rows
    with a null id keep all and remove nothing; repeated rows of one id share its result and do
    not remove each other. Other columns are not carried.
    """
    if not is_cover(cover, period) or period > window:
        raise ValueError("need a difference cover with a period of at most the window")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                       F.col(text_col).alias("text"))
    base = stored(rows.mapInArrow(_base, BASE))
    # whole copies: all but those of the smallest id lose every word
    # (a table of its own, so that a hot digest is split in the join)
    least = stored(base.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()) \
        .groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")) \
        .where("least < most"))
    copies = base.select("doc_id", "digest").join(least, "digest").where("doc_id > least") \
        .select("doc_id", "digest").distinct()
    copies = stored(copies)

    def anchors(batch: pa.RecordBatch):
        for block in blocks(iter([batch])):
            words = split(block.column(1))
            hashes, at = _anchor_hashes(words, window, period, cover)
            yield hashes, block.column(0).to_numpy(zero_copy_only=False)[words.row[at]].astype(np.int64)

    texts = rows.where("doc_id IS NOT NULL").select("doc_id", "text")
    shared = shared_pairs(texts, anchors, smaller=False) \
        .groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    wanted = base.join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "text_key") \
        .join(shared, "doc_id").dropDuplicates(["doc_id", "text_key"])
    found = stored(rows.where("doc_id IS NOT NULL").join(wanted, ["doc_id", "text_key"])
                   .select("doc_id", "text", "hashes")
                   .mapInArrow(_candidates(window, period, cover), "doc_id long, text string, ranges array<int>"))
    found = found.where(F.size("ranges") > 0)

    def whole(batch: pa.RecordBatch):
        for block in blocks(iter([batch])):
            hashes, at, words = _window_hashes(block, window)
            yield hashes, block.column(0).to_numpy(zero_copy_only=False)[words.row[at]].astype(np.int64)

    gone = shared_pairs(found, whole, smaller=True).groupBy("doc_id").agg(F.collect_set("hash").alias("gone"))
    changed = found.join(gone, "doc_id").select("doc_id", "text", "ranges", "gone",
                                                F.xxhash64("text").alias("text_key")) \
        .mapInArrow(_outcome(window), "doc_id long, n_removed long, kept_sha256 string, text_key long, "
                                      "kept_text string") \
        .dropDuplicates(["doc_id", "text_key"])
    empty = F.sha2(F.lit(""), 256)
    return base.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "digest"], "left") \
        .join(changed, ["doc_id", "text_key"], "left") \
        .select("doc_id", "n_words",
                F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
                .alias("n_removed"),
                F.when(F.col("copy"), empty).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
                "text_key", F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs`, all columns, with repeated passages cut from the texts; texts cut whole are dropped.

    Repeated rows of one id and text stay repeated. Columns may have any names.
    """
    cut = removals(docs, id_col, text_col, **options).where("n_removed > 0") \
        .select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "kept_text",
                F.lit(True).alias("cut")).dropDuplicates(["id", "key"])
    # the row as one value, so that its names can't clash with these
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"),
                       F.xxhash64(docs[text_col]).alias("key"))
    out = rows.join(cut, ["id", "key"], "left").where("cut IS NULL OR trim(kept_text) <> ''")
    text = F.when(F.col("cut"), F.col("kept_text")).otherwise(F.col("row")[text_col])
    return out.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
