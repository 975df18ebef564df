"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

The automaton holds every substring of every item, by words. The words of a document are streamed
through it; it gives the longest item substring that ends at each word. Where that reaches the
window length, the words of the window are hit and the automaton's state names the items. Only
stretches of words that all occur in the benchmark, and that are as long as the shortest window,
are streamed: any other word would reset the automaton.

The items are read to the driver in blocks of at most `BLOCK_WORDS` words, so the automaton that is
sent to the executors has a fixed bound; more items take more passes, whose hits are merged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm.words import ALNUM, blocks, split

WINDOW = 13
BLOCK_WORDS = 200_000
HITS = "doc_id long, text string, n_words long, spans array<struct<s:long,e:long>>, items array<string>"


class Automaton:
    """Suffix automaton of several sequences; states know the items that hold their substrings."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        tops: list[tuple[int, str, int]] = []
        paths: list[tuple[str, list[int]]] = []
        for name, words in items:
            if not words:
                continue
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            if len(words) < window:
                tops.append((last, name, len(words)))
            else:
                paths.append((name, words))
        # items of each state: walk each item again, now that states no longer split
        self.names: list[set[str]] = [set() for _ in self.next]
        for name, words in paths:
            state = 0
            for w in words:
                state = self.next[state][w]
                at = state
                while at > 0 and name not in self.names[at]:
                    self.names[at].add(name)
                    at = self.link[at]
        # items shorter than a window are found whole, on the chain of suffix links
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for state, name, size in tops:
            self.short[state].append((size, name))
        self.any_short = bool(tops)
        if tops:
            for state in sorted(range(len(self.next)), key=lambda s: self.length[s]):
                if state:
                    self.short[state] = self.short[state] + self.short[self.link[state]]
        self.shortest = min([window, *(size for _, _, size in tops)])

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the substrings of `q` up to those that end in `p` and `w`."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def stream(self, words: list[int], base: int, spans: list, names: set) -> None:
        """Add the hit spans (positions from `base` on) and the items of one stretch of words."""
        state, size, window = 0, 0, self.window
        nexts, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                size = length[state]
            if w in nexts[state]:
                state = nexts[state][w]
                size += 1
            else:
                size = 0
            end = base + i + 1
            if size >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                if self.names[at]:
                    names |= self.names[at]
                    _cover(spans, end - window, end)
            if self.any_short:
                for n, name in self.short[state]:
                    if n <= size:
                        names.add(name)
                        _cover(spans, end - n, end)


def _cover(spans: list, start: int, end: int) -> None:
    """Append a span; spans arrive by their ends and are kept disjoint."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def _matches(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    texts = split(pa.array([t or "" for _, t in items], pa.string()), ALNUM, lower=True)
    vocabulary, ids = np.unique(texts.hashes(), return_inverse=True)
    words = [(name, ids[texts.first[i]:texts.first[i + 1]].tolist()) for i, (name, _) in enumerate(items)]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, Automaton(words, window)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, automaton = shared.value
        for block in blocks(batches):
            text = split(block.column(1), ALNUM, lower=True)
            spans: list[list] = [[] for _ in range(text.n_rows)]
            names: list[set] = [set() for _ in range(text.n_rows)]
            if len(vocabulary) and len(text.start):
                hashes = text.hashes()
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                opens, closes = known.copy(), known.copy()
                same = text.row[1:] == text.row[:-1]
                opens[1:] &= ~(known[:-1] & same)
                closes[:-1] &= ~(known[1:] & same)
                starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
                long = ends - starts >= automaton.shortest
                for s, e in zip(starts[long].tolist(), ends[long].tolist()):
                    row = int(text.row[s])
                    automaton.stream(at[s:e].tolist(), s - int(text.first[row]), spans[row], names[row])
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(text.counts().astype(np.int64)),
                 pa.array([[{"s": s, "e": e} for s, e in x] for x in spans],
                          pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                 pa.array([sorted(x) for x in names], pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(match, HITS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several passes over the same document as disjoint ones."""
    for batch in batches:
        out = []
        for spans in batch.column(3).to_pylist():
            own: list = []
            for s, e in sorted((x["s"], x["e"]) for x in spans or []):
                if own and own[-1][1] >= s:
                    own[-1] = (own[-1][0], max(own[-1][1], e))
                else:
                    own.append((s, e))
            out.append([{"s": s, "e": e} for s, e in own])
        yield batch.set_column(3, batch.schema.field(3), pa.array(out, batch.schema.field(3).type))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, text, n_words, spans (disjoint word ranges), items.

    A window is `window` consecutive words of an item, or all words of a shorter one. Null texts
    and items without words have none and match nothing; items with a null id are named ''.
    Repeated documents count each, repeated items once. Other columns are not carried.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0  # a word and a gap are two characters
    n = max(1, math.ceil(size / 2 / block_words))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    passes = []
    for i in range(n):
        own = items.where(part == i).collect() if n > 1 else items.collect()
        passes.append(_matches(rows, [(r["item"], r["text"]) for r in own], window))
    if n == 1:
        return passes[0]
    found = passes[0]
    for i, other in enumerate(passes):
        tagged = other.withColumn("pass", F.lit(i))
        found = tagged if i == 0 else found.unionByName(tagged)
    # the nth equal row of a document is the same in each pass
    key = ["doc_id", F.xxhash64("text").alias("text_hash")]
    nothing = F.size("items") == 0
    hits = found.where(~nothing).select(*key, "spans", "items").distinct() \
        .groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
                                            .alias("items"))
    base = passes[0].select("doc_id", "text", "n_words", F.xxhash64("text").alias("text_hash"))
    empty = F.array().cast("array<struct<s:long,e:long>>")
    joined = base.alias("b").join(hits.alias("h"), F.col("b.doc_id").eqNullSafe(F.col("h.doc_id"))
                                  & F.col("b.text_hash").eqNullSafe(F.col("h.text_hash")), "left") \
        .select("b.doc_id", "b.text", "b.n_words", F.coalesce("h.spans", empty).alias("spans"),
                F.coalesce("h.items", F.array().cast("array<string>")).alias("items"))
    return joined.mapInArrow(_merged, HITS)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256")) \
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, max_span: int | None = None, text_col: str = "text",
          id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` (its id and text) without contaminated documents: those whose hit words reach a
    twentieth of all words. With `max_span`, hit spans longer than that many words are cut from
    the texts of the others; what stays keeps its white space.
    """
    found = matches(docs, benchmark, id_col, text_col, **options)
    kept = found.where(~((F.size("spans") > 0) & (20 * F.aggregate(
        "spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]) >= F.col("n_words"))))
    if max_span is None:
        return kept.select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            text, out = split(block.column(1), ALNUM, lower=True), []
            raw = split(block.column(1))
            for r, spans in enumerate(block.column(2).to_pylist()):
                a, b = int(raw.bounds[r]), int(raw.bounds[r + 1])
                parts, first = [], int(text.first[r])
                for x in spans:
                    if x["e"] - x["s"] > max_span:
                        parts.append(raw.data[a:text.start[first + x["s"]]].tobytes())
                        a = int(text.end[first + x["e"] - 1])
                parts.append(raw.data[a:b].tobytes())
                out.append(b"".join(parts).decode("utf-8", "replace"))
            valid = block.column(1).is_valid()
            out = pa.compute.if_else(valid, pa.array(out, pa.string()), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([block.column(0), out], names=["doc_id", "text"])

    return kept.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, text string") \
        .select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col))


def digest(items: list[str]) -> str:
    """The digest of `report`, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
