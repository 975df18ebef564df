"""Near-duplicate classes by ProbMinHash.

A document is a weighted set of five-word shingles (weight 1 + ln count). Each shingle is a Poisson
process of that rate: its arrivals fall into random registers, and a register keeps the shingle
that arrives first. A shingle stops as soon as its next arrival is later than all registers hold.
Two documents agree in a register with the probability Jaccard similarity of their weighted sets.
Registers are banded; documents that share a band are candidates and are verified on their whole
shingle sets (Jaccard similarity of 0.8 or more). Classes are the connected components.

Repeated passages can pull the weighted similarity of two similar sets far down. So a second family
of bands comes from the same process with every weight 1, where registers agree with the Jaccard
similarity of the sets. With 28 bands of 4 registers there, a pair of similarity 0.8 is missed with
a chance of 4 in 10 million, however often its shingles repeat. Both families are one where nothing
repeats.

A band that holds thousands of documents is never expanded into all pairs: first each document is
verified against one leader, then against the leaders of its other bands where those are not yet of
its class. Documents of bands that still hold several classes go through an exact prefix join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm.components import components
from styloweave.llm.storage import stored
from styloweave.llm.words import STEP, Words, blocks, mix, split, window_rows, windows

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 4
SIGNED = "doc_id long, text_key long, n_words long, n_shingles long, digest string, bands array<long>"
U64 = np.uint64
ID_BITS = U64(44)
SKETCH = 1 << 18


def shingles(words: Words, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and count of each distinct shingle; a row of fewer words is one shingle.

    Ids are 44 bits of a hash; rows of a block are below 2^20.
    """
    hashes = words.hashes()
    inside = window_rows(words, length)
    found = [(words.row[:len(inside)][inside], windows(hashes, length)[inside])]
    counts = words.counts()
    for n in range(1, length):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            found.append((rows, windows(hashes, n)[words.first[rows]]))
    rows, ids = (np.concatenate(x) for x in zip(*found))
    keys = (rows.astype(U64) << ID_BITS) | (ids >> U64(20))
    keys, times = np.unique(keys, return_counts=True)
    return (keys >> ID_BITS).astype(np.int64), keys & ((U64(1) << ID_BITS) - U64(1)), times


def prob_min_hash(row: np.ndarray, ids: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """A signature of `k` registers for each row; the same weighted set gives the same one."""
    best = np.full(n_rows * k, np.inf)
    first = np.zeros(n_rows * k, U64)
    seed = mix(ids + STEP)
    time = np.zeros(len(ids))
    turn = 0
    while len(ids):
        turn += 1
        draw = mix(seed + STEP * np.full(1, turn, U64))
        time = time - np.log1p(-(draw >> U64(11)).astype(np.float64) * 2.0**-53) / weight
        at = row * k + (mix(draw ^ STEP) % U64(k)).astype(np.int64)
        np.minimum.at(best, at, time)
        won = best[at] == time
        first[at[won]] = ids[won]
        present, place = np.unique(row, return_inverse=True)
        latest = best.reshape(n_rows, k)[present].max(axis=1)
        going = time < latest[place]
        row, ids, seed, weight, time = (x[going] for x in (row, ids, seed, weight, time))
    return first.reshape(n_rows, k)


def banded(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of registers and its number."""
    signature = signature.reshape(len(signature), bands, rows)
    mixed = np.zeros((len(signature), bands), U64) + np.arange(1, bands + 1, dtype=U64)
    for j in range(rows):
        mixed = mix(mixed ^ signature[:, :, j])
    return mixed


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text=2):
            words = split(block.column(2))
            n = words.n_rows
            row, ids, times = shingles(words)
            plain = prob_min_hash(row, ids, np.ones(len(ids)), n, bands * rows)
            again = np.bincount(row[times > 1], minlength=n) > 0
            more = again[row]
            place = np.cumsum(again) - 1
            weighted = prob_min_hash(place[row[more]], ids[more], 1 + np.log(times[more]), int(again.sum()), bands * rows)
            family = [banded(x, bands, rows) for x in (plain, weighted)]
            some = words.counts() > 0
            # a band that both families have equal counts once
            fresh = np.ones((n, 2, bands), bool)
            both = np.zeros((n, 2, bands), U64)
            both[:, 0] = family[0]
            both[again, 1] = family[1]
            fresh[:, 0] = some[:, None]
            fresh[:, 1] = again[:, None] & (both[:, 0] != both[:, 1])
            offsets = np.concatenate(([0], np.cumsum(fresh.sum(axis=(1, 2))))).astype(np.int32)
            tokens = [t.encode().split() if t else [] for t in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(words.counts().astype(np.int64)),
                 pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                 pa.array([hashlib.sha256(b" ".join(t)).hexdigest() for t in tokens], pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(both[fresh].view(np.int64)))],
                names=["doc_id", "text_key", "n_words", "n_shingles", "digest", "bands"])
    return run


def _verified(threshold: float):
    """Pairs whose shingle sets have at least this Jaccard similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(iter([batch]), text=2):
                row_a, ids_a, _ = shingles(split(block.column(2)))
                row_b, ids_b, _ = shingles(split(block.column(3)))
                keys = np.concatenate(((row_a.astype(U64) << ID_BITS) | ids_a, (row_b.astype(U64) << ID_BITS) | ids_b))
                keys.sort()
                twice = keys[1:][keys[1:] == keys[:-1]]
                n = len(block)
                both = np.bincount((twice >> ID_BITS).astype(np.int64), minlength=n)
                either = np.bincount(row_a, minlength=n) + np.bincount(row_b, minlength=n) - both
                similar = pa.array(both >= threshold * either)
                yield pa.RecordBatch.from_arrays([block.column(0).filter(similar), block.column(1).filter(similar)],
                                                 names=["a", "b"])
    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.int64)
    for block in blocks(batches, text=2):
        _, ids, _ = shingles(split(block.column(2)))
        total += np.bincount((ids % U64(SKETCH)).astype(np.int64), minlength=SKETCH)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])


def prefix_pairs(docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of `docs` (doc, label, text) that may reach the threshold and differ in label; none is missed.

    With the shingles of each set in one order, from rare to frequent, two similar sets have a
    common shingle among the first n - ceil(threshold n) + 1 of each; and at the first common one,
    at places i and j, min(n_a - i, n_b - j) is at least their overlap. Passages that many documents
    share come last in the order, so they make no pairs of documents that differ elsewhere. The
    order uses frequencies in a table of fixed size; any order gives whole results.
    """
    counted = docs.mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")) \
        .toArrow()  # at most SKETCH rows
    frequency = np.zeros(SKETCH, np.int64)
    frequency[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text=2):
            row, ids, _ = shingles(split(block.column(2)))
            order = np.lexsort((ids, shared.value[(ids % U64(SKETCH)).astype(np.int64)], row))
            row, ids = row[order], ids[order]
            size = np.bincount(row, minlength=len(block))
            place = np.arange(len(row)) - np.concatenate(([0], np.cumsum(size)))[row]
            first = place < (size - np.ceil(threshold * size - 1e-9) + 1)[row]
            row, ids, place = row[first], ids[first], place[first]
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(pa.array(row)), block.column(1).take(pa.array(row)), pa.array(size[row]),
                 pa.array(place), pa.array(ids.view(np.int64))], names=["doc", "label", "size", "place", "shingle"])

    rows = stored(docs.mapInArrow(prefixes, "doc long, label long, size long, place long, shingle long"))
    several = stored(rows.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                     .where("low < high").select("shingle"))
    rows = stored(rows.join(several, "shingle"))
    x, y = rows.alias("x"), rows.alias("y")
    need = F.lit(threshold / (1 + threshold)) * (F.col("x.size") + F.col("y.size")) - F.lit(1e-6)
    possible = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) >= need
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label"))
                  & (F.col("x.doc") < F.col("y.doc")) & possible) \
        .select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (smallest id of its class), n_words, text_key.

    Texts of equal words are one class. A text without words (null, empty) is a class of its own.
    A null id has a null class. Repeated rows get the same class each. Other columns are not carried.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                        F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signed(bands, rows), SIGNED))
    # equal texts: one representative stands for all
    copies = stored(signed.where("n_words > 0 AND doc_id IS NOT NULL").groupBy("digest")
                    .agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("size"),
                         F.first("bands").alias("bands"))
                    .select("digest", F.col("rep.doc_id").alias("doc"), "rep.text_key", "size", "bands"))
    members = copies.select("doc", "size", F.explode("bands").alias("bucket"))
    # tables of their own, so that hot keys are split in the joins
    shared = stored(members.groupBy("bucket").agg(F.min("doc").alias("leader"), F.max("doc").alias("last"))
                    .where("leader < last").select("bucket", "leader"))
    members = stored(members.join(shared, "bucket"))
    wanted = members.select("doc").distinct().join(copies.select("doc", "text_key"), "doc")
    held = stored(texts.withColumnRenamed("doc_id", "doc").join(wanted, ["doc", "text_key"])
                  .select("doc", "text").dropDuplicates(["doc"]))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = held.toDF("a", "text_a"), held.toDF("b", "text_b")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b") \
            .mapInArrow(_verified(threshold), "a long, b long")

    sizes = members.select("doc", "size").distinct()

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose set sizes allow the threshold."""
        a, b = sizes.toDF("a", "size_a"), sizes.toDF("b", "size_b")
        return pairs.join(a, "a").join(b, "b").where(
            F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b")).select(*pairs.columns)

    stars = stored(possible(members.where("leader < doc").groupBy(F.col("leader").alias("a"), F.col("doc").alias("b"))
                            .agg(F.count("*").alias("n"))))
    # the leader with most bands in common first
    best = stars.groupBy("b").agg(F.max(F.struct("n", -F.col("a"))).alias("top")) \
        .select((-F.col("top.col2")).alias("a"), "b")
    edges = stored(verify(best))
    labels = components(edges)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose documents are not of one class yet."""
        a, b = labels.toDF("a", "label_a"), labels.toDF("b", "label_b")
        return pairs.join(a, "a", "left").join(b, "b", "left") \
            .where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")

    tried = stars.select("a", "b")
    more = stored(verify(apart(tried.join(best, ["a", "b"], "left_anti"))))
    edges = edges.union(more)
    labels = components(edges)
    # bands that still hold several classes: an exact join of the sets of their documents
    marked = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left") \
        .select("bucket", "doc", F.coalesce("label", "doc").alias("label"))
    mixed = stored(marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                   .where("low < high").select("bucket"))
    contested = stored(marked.join(mixed, "bucket").select("doc", "label").distinct().join(held, "doc")
                       .select("doc", "label", "text"))
    cross = prefix_pairs(contested, threshold).join(tried, ["a", "b"], "left_anti")
    edges = edges.union(stored(verify(cross)))
    labels = components(edges)
    classes = stored(copies.select("digest", "doc").join(labels, F.col("doc") == F.col("node"), "left")
                     .select("digest", F.coalesce("label", "doc").alias("class")))
    return signed.join(classes, "digest", "left") \
        .select("doc_id", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long"))
                .when(F.col("n_words") > 0, F.col("class")).otherwise(F.col("doc_id")).alias("class_id"),
                "n_words", "text_key")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs`, all columns, with one document (the smallest id) of each class.

    Of repeated rows of one id one stays. Rows with a null id stay. Columns may have any names.
    """
    kept = near_classes(docs, id_col, text_col, **options).where("doc_id = class_id") \
        .select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    # the row as one value, so that its names can't clash with these
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"),
                       F.xxhash64(docs[text_col]).alias("key"))
    one = rows.where("id IS NOT NULL").join(kept, ["id", "key"], "left_semi").dropDuplicates(["id"])
    return one.select("row.*").unionByName(docs.where(docs[id_col].isNull()))
