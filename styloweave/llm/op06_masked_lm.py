"""Masked pseudo-likelihood of documents by a bidirectional window network, trained in numpy.

Each word is predicted from the two words on either side. Position-wise embeddings of the four are
summed and pass through tanh; the prediction is a two-level softmax, first over groups of words and
then over the words of the group. The vocabulary is the most frequent words of the whole corpus;
all others share hash buckets, within which a word is as likely as its share of the bucket's
occurrences. Vocabulary and buckets grow with the square root of the distinct words; the counts of
words outside the vocabulary stay in Spark. They meet the documents' words in ranges of hashes, whose
number grows with the words of the corpus: a block of documents sends each range one row of sorted hashes, and gets
back a sum for each document.

Each partition trains on all its words from the same start; the parameters are averaged by words,
summed in groups of bounded size. The score of a document is the sum of the conditional log
probabilities of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm.storage import stored
from styloweave.llm.words import Words, blocks, mix, split

GROUPS, GROUP_SIZE, BUCKETS, WIDTH, CONTEXT = 32, 32, 64, 16, (-2, -1, 1, 2)
BATCH, RATE = 16_384, 0.2
#: Distinct words that a corpus may have before groups and buckets double; then at every fourfold.
FEW = 1 << 19
PAD = GROUPS * GROUP_SIZE
PIECE = 2_048
#: Words of the corpus for each range of hashes, and the fewest ranges.
RANGE_WORDS, RANGES = 1 << 21, 256
SCORED = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("hashes", pa.binary()), ("times", pa.binary()),
                    ("places", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
                    ("log_prob", pa.list_(pa.float64()))])
SCORED_SQL = ("block long, range long, hashes binary, times binary, places binary, doc_id array<long>, "
              "n_words array<long>, log_prob array<double>")
ADDED = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("sums", pa.binary()), *list(SCORED)[5:]])
ADDED_SQL = "block long, places binary, sums binary, doc_id array<long>, n_words array<long>, log_prob array<double>"


def buckets_for(distinct: int) -> int:
    """A power of two that grows with the square root of the distinct words."""
    n = BUCKETS
    while distinct > FEW * (n // BUCKETS) ** 2:
        n *= 2
    return n


class Vocabulary:
    """Ids of words by their hash: listed words by frequency, then hash buckets."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, bucket_counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        self.buckets = len(bucket_counts)
        self.pad = self.buckets * (PAD // BUCKETS)
        self.listed = self.pad - self.buckets
        listed = np.zeros(self.listed)
        listed[:len(counts)] = counts
        #: add-one smoothed frequency of each id
        self.frequency = np.concatenate([listed, bucket_counts]) + 1.0
        #: log of the occurrences of each bucket
        self.log_bucket = np.log(np.maximum(bucket_counts, 1))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        bucket = self.listed + (hashes % np.uint64(self.buckets)).astype(np.int32)
        if not len(self.hashes):
            return bucket
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], bucket)


def contexts(ids: np.ndarray, words: Words, pad: int = PAD) -> np.ndarray:
    """The ids around each word, `pad` beyond the ends of its row."""
    out = np.full((len(ids), len(CONTEXT)), pad, np.int32)
    at, n = np.arange(len(ids)), len(ids)
    for k, step in enumerate(CONTEXT):
        place = at + step
        good = (place >= 0) & (place < n)
        good[good] &= words.row[place[good]] == words.row[at[good]]
        out[good, k] = ids[place[good]]
    return out


class Network:
    """Parameters as named float32 arrays."""

    def __init__(self, frequency: np.ndarray, seed: int = 6):
        rng = np.random.default_rng(seed)
        share = frequency.reshape(-1, GROUP_SIZE)
        self.groups = groups = len(share)
        self.p = {
            "embed": rng.normal(0, 0.1, (len(CONTEXT), len(frequency) + 1, WIDTH)), "bias": np.zeros(WIDTH),
            "group": rng.normal(0, 0.1, (WIDTH, groups)), "group_bias": np.log(share.sum(1) / share.sum()),
            "word": rng.normal(0, 0.1, (groups, WIDTH, GROUP_SIZE)),
            "word_bias": np.log(share / share.sum(1, keepdims=True)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.seen = {k: np.full_like(v, 0.1) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, values: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def _hidden(self, near: np.ndarray) -> np.ndarray:
        total = np.repeat(self.p["bias"][None], len(near), axis=0)
        for k in range(len(CONTEXT)):
            total += np.take(self.p["embed"][k], near[:, k], axis=0)
        return np.tanh(total)

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        # single precision holds exponentials of this range, so no maximum of the row is needed
        np.clip(logits, -80, 60, out=logits)
        np.exp(logits, out=logits)
        logits /= (logits @ np.ones(logits.shape[1], np.float32))[:, None]
        return logits

    def _by_group(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the words by group, and the bounds of groups in it."""
        group = ids // GROUP_SIZE
        order = np.argsort(group.astype(np.uint16) if self.groups < 1 << 16 else group, kind="stable")
        return order, np.concatenate(([0], np.cumsum(np.bincount(group, minlength=self.groups))))

    def _inside(self, hidden: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probabilities within the group of each word, of words in order of their groups."""
        logits = np.empty((len(hidden), GROUP_SIZE), np.float32)
        for g in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[g], bounds[g + 1]
            np.matmul(hidden[a:b], self.p["word"][g], out=logits[a:b])
            logits[a:b] += self.p["word_bias"][g]
        return self._softmax(logits)

    def log_probabilities(self, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        order, bounds = self._by_group(ids)
        ids, line = ids[order], np.arange(len(ids))
        hidden = self._hidden(near[order])
        groups = self._softmax(hidden @ self.p["group"] + self.p["group_bias"])
        inside = self._inside(hidden, bounds)
        out = np.empty(len(ids))
        out[order] = np.log((groups[line, ids // GROUP_SIZE].astype(np.float64) + 1e-30)
                            * (inside[line, ids % GROUP_SIZE] + 1e-30))
        return out

    def train(self, ids: np.ndarray, near: np.ndarray, rate: float = RATE) -> None:
        """One Adagrad step on the mean loss of a batch."""
        n = np.float32(len(ids))
        order, bounds = self._by_group(ids)
        ids, near, line = ids[order], np.take(near, order, axis=0), np.arange(len(ids))
        hidden = self._hidden(near)
        error = self._softmax(hidden @ self.p["group"] + self.p["group_bias"])
        error[line, ids // GROUP_SIZE] -= 1
        inside = self._inside(hidden, bounds)
        inside[line, ids % GROUP_SIZE] -= 1
        back = error @ self.p["group"].T
        ones = np.ones(len(ids), np.float32)
        slope = {"group": hidden.T @ error, "group_bias": ones @ error,
                 "word": np.zeros_like(self.p["word"]), "word_bias": np.zeros_like(self.p["word_bias"])}
        for g in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[g], bounds[g + 1]
            back[a:b] += inside[a:b] @ self.p["word"][g].T
            slope["word"][g] = hidden[a:b].T @ inside[a:b]
            slope["word_bias"][g] = ones[a:b] @ inside[a:b]
        back *= 1 - hidden * hidden
        slope["bias"] = ones @ back
        for k, v in slope.items():
            self._step(self.p[k], self.seen[k], v / n, rate)
        small = self.p["embed"].shape[1] < 1 << 16
        for k in range(len(CONTEXT)):
            own = near[:, k]
            order = np.argsort(own.astype(np.uint16) if small else own, kind="stable")  # 16 bits sort by radix
            sorted_ = own[order]
            start = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            touched = sorted_[start]
            total = np.add.reduceat(np.take(back, order, axis=0), start, axis=0) / n
            seen = self.seen["embed"][k]
            seen[touched] += total * total * n
            self.p["embed"][k][touched] -= rate * total * np.sqrt(n) / np.sqrt(seen[touched])

    @staticmethod
    def _step(value: np.ndarray, seen: np.ndarray, slope: np.ndarray, rate: float) -> None:
        seen += slope * slope
        value -= rate * slope / np.sqrt(seen)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        hashes, n = np.unique(split(block.column(1)).hashes(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))],
                                         names=["hash", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, n) of every distinct word of the corpus, stored."""
    return stored(texts.mapInArrow(_word_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))


def vocabulary(texts: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """Counts over the whole corpus; only the listed words and the sums of buckets leave Spark."""
    counts = word_counts(texts) if counts is None else counts
    buckets = buckets_for(counts.count())
    top = counts.orderBy(F.col("n").desc(), "hash").limit(buckets * (PAD // BUCKETS) - buckets).collect()  # the vocabulary
    hashes = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.float64)
    # the residue of the hash as an unsigned number: a power of two divides 2^64
    sums = counts.groupBy(F.pmod("hash", F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets)
    for r in sums:
        total[r["bucket"]] = r["n"]
    total -= np.bincount((hashes % np.uint64(buckets)).astype(np.int64), n, buckets)
    return Vocabulary(hashes, n, total)


def trained(texts: DataFrame, words: Vocabulary, batch: int = BATCH, rate: float = RATE) -> Network:
    """One pass over all words: partitions train apart, their parameters are averaged."""
    def local(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, seen, held, waiting = Network(words.frequency), 0, [], 0

        def steps(last: bool) -> None:
            nonlocal held, waiting
            ids, near = (np.concatenate(x) for x in zip(*held))
            end = len(ids) if last else len(ids) - len(ids) % batch
            for a in range(0, end, batch):
                network.train(ids[a:min(a + batch, end)], near[a:min(a + batch, end)], rate)
            held, waiting = [(ids[end:], near[end:])], len(ids) - end

        for block in blocks(frames):
            text = split(block.column(1))
            ids = words.of(text.hashes())
            held.append((ids, contexts(ids, text, words.pad)))
            waiting += len(ids)
            seen += len(ids)
            if waiting >= batch:
                steps(False)
        if waiting:
            steps(True)
        if seen:
            flat = network.flat().astype(np.float64)
            pieces = [flat[a:a + PIECE] for a in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(pieces)), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * len(pieces), pa.int32()),
                 pa.array([float(seen)] * len(pieces)), pa.array([x.tobytes() for x in pieces], pa.binary())],
                names=["piece", "part", "weight", "values"])

    def averaged(rows: pa.Table) -> pa.Table:
        weight = rows["weight"].to_numpy()
        order = np.argsort(weight, kind="stable")
        values = np.stack([np.frombuffer(x) for x in rows["values"].to_pylist()])[order]
        mean = np.average(values, axis=0, weights=weight[order])
        return pa.table({"piece": rows["piece"][:1], "part": rows["part"][:1], "weight": [weight.sum()],
                         "values": pa.array([mean.tobytes()], pa.binary())})

    schema = "piece int, part int, weight double, values binary"
    rows = texts.mapInArrow(local, schema).groupBy("piece", "part").applyInArrow(averaged, schema) \
        .groupBy("piece").applyInArrow(averaged, schema).orderBy("piece").collect()  # the model
    network = Network(words.frequency)
    return network.load(np.concatenate([np.frombuffer(r["values"]) for r in rows])) if rows else network


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH,
                      rate: float = RATE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, log_prob (sum), mean_log_prob (0 without words).

    Null texts have no words. Null ids stay null, repeated rows are scored (and learnt from) each,
    other columns are not carried.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = word_counts(texts)
    words = vocabulary(texts, counts)
    network = trained(texts, words, batch, rate)
    ranges = max(RANGES, (counts.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block one row of its documents, and for each range one of its words outside the vocabulary."""
        for k, block in enumerate(blocks(batches)):
            text = split(block.column(1))
            hashes = text.hashes()
            ids = words.of(hashes)
            near = contexts(ids, text, words.pad)
            each = np.concatenate([np.zeros(0), *(network.log_probabilities(ids[a:a + BATCH], near[a:a + BATCH])
                                                  for a in range(0, len(ids), BATCH))])
            each -= np.concatenate([np.zeros(words.listed), words.log_bucket])[ids]
            total = np.concatenate(([0.0], np.cumsum(each)))
            total = total[text.first[1:]] - total[text.first[:-1]]
            name = TaskContext.get().partitionId() << 32 | k
            spread = int(mix(np.array([name], np.uint64))[0]) % ranges
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([spread]), *(pa.nulls(1, pa.binary()) for _ in range(3)),
                 pa.array([block.column(0).to_pylist()], pa.list_(pa.int64())),
                 pa.array([text.counts().astype(np.int64)], pa.list_(pa.int64())), pa.array([total], pa.list_(pa.float64()))],
                schema=SCORED)
            rare = np.flatnonzero(ids >= words.listed)
            order = rare[np.argsort(hashes[rare], kind="stable")]
            if len(order):
                found, places = hashes[order], text.row[order].astype(np.int32)
                start = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
                times = np.diff(start, append=len(found)).astype(np.int32)
                distinct = found[start]
                # ranges are in the order of hashes
                of = ((distinct >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                ends, at = np.append(cut[1:], len(of)), np.append(start, len(found))
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, name)), pa.array(of[cut]),
                     pa.array([distinct[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                     pa.array([times[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                     pa.array([places[at[a]:at[b]].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                     *(pa.nulls(n, f.type) for f in list(SCORED)[5:])], schema=SCORED)

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        """The words of one range: for each block the sum of their log counts by document."""
        heads = rows.filter(rows["hashes"].is_null())
        hashes = known["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, logs = hashes[order], np.log(known["n"].to_numpy()[order])
        out: list[tuple] = []
        own = rows.filter(rows["hashes"].is_valid()).select(["block", "hashes", "times", "places"])
        for block, found, times, places in zip(*(c.to_pylist() for c in own.columns)):
            found = np.frombuffer(found, np.uint64)
            at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
            value = np.where(hashes[at] == found, logs[at], 0.0) if len(hashes) else np.zeros(len(found))
            sums = np.bincount(np.frombuffer(places, np.int32), np.repeat(value, np.frombuffer(times, np.int32)))
            there = np.flatnonzero(sums)
            if len(there):
                out.append((block, there.astype(np.int32).tobytes(), sums[there].tobytes()))
        sums = pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out) if out else ((), (), ()), ADDED)]
            + [pa.nulls(len(out), f.type) for f in list(ADDED)[3:]], schema=ADDED)
        empty = pa.nulls(len(heads), pa.binary())
        heads = pa.Table.from_arrays([heads["block"], empty, empty, *(heads[f.name] for f in list(ADDED)[3:])], schema=ADDED)
        return pa.concat_tables([heads, sums])

    def finish(rows: pa.Table) -> pa.Table:
        """The documents of a block, with the sums of their words outside the vocabulary added."""
        head = rows.filter(rows["places"].is_null())
        total = head["log_prob"].combine_chunks().flatten().to_numpy().copy()
        n = head["n_words"].combine_chunks().flatten()
        sums = rows.filter(rows["places"].is_valid())
        if len(sums):
            # in a fixed order, so that equal runs give equal sums
            parts = sorted(zip(sums["places"].to_pylist(), sums["sums"].to_pylist()))
            total += np.bincount(np.frombuffer(b"".join(p for p, _ in parts), np.int32),
                                 np.frombuffer(b"".join(s for _, s in parts)), len(total))
        return pa.table({"doc_id": head["doc_id"].combine_chunks().flatten(), "n_words": n, "log_prob": total,
                         "mean_log_prob": total / np.maximum(n.to_numpy(), 1)})

    # a word that occurs once adds nothing, as the logarithm of 1 is 0
    several = counts.where("n > 1").withColumn(
        "range", F.shiftright(F.shiftrightunsigned("hash", 32) * F.lit(ranges), 32))
    return texts.mapInArrow(score, SCORED_SQL).groupBy("range").cogroup(several.groupBy("range")) \
        .applyInArrow(look_up, ADDED_SQL).groupBy("block") \
        .applyInArrow(finish, "doc_id long, n_words long, log_prob double, mean_log_prob double")
