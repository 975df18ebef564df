"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic scores.

Each document becomes a few statistics of its bytes, words and lines. Random Fourier features of
the standardised statistics approximate a Gaussian kernel. Partitions sum their part of the normal
equations by fold; the driver solves systems of `FEATURES` unknowns, however many rows there are.
Scores of held-back folds, each by the model of the other folds (the total less the fold's sums),
are calibrated by isotonic regression over a histogram of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloweave.llm.storage import stored
from styloweave.llm.words import blocks, split, window_rows, windows

FEATURES, RIDGE, WIDTH = 256, 1e-3, 1.0
BINS = 2_000
LEARNED_FOLDS = (1, 2, 3, 4)
PREDICT_FROM = 0.3


def _table(characters: str) -> np.ndarray:
    return np.array([b < 128 and chr(b) in characters for b in range(256)])


KINDS = {
    "lower": _table("abcdefghijklmnopqrstuvwxyz"), "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _table("0123456789"), "mark": _table(".,;:!?'\"()-"), "symbol": _table("#*$%&|<>"),
    "space": _table(" \t\n\v\f\r"), "newline": _table("\n"), "wide": np.arange(256) >= 128,
}


def _repeats(row: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """Share of values of each row that repeat an earlier one of the row."""
    keys = (row.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
    distinct = np.bincount((np.unique(keys) >> np.uint64(44)).astype(np.int64), minlength=n_rows)
    total = np.bincount(row, minlength=n_rows)
    return (total - distinct) / np.maximum(total, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers per text; an empty text is all zeros."""
    words = split(column)
    n, data = words.n_rows, words.data
    size = np.diff(words.bounds)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind[data])))
        return np.diff(total[words.bounds]) / np.maximum(size, 1)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(words.row, values, n) / np.maximum(words.counts(), 1)

    length = (words.end - words.start).astype(np.float64)
    some = len(words.start) > 0
    first = data[words.start] if some else np.zeros(0, np.uint8)
    last = data[words.end - 1] if some else np.zeros(0, np.uint8)
    second = data[np.minimum(words.start + 1, words.end - 1)] if some else np.zeros(0, np.uint8)
    hashes, average = words.hashes(), mean(length)
    three = window_rows(words, 3)
    lines = split(column, np.arange(256) != 10)
    return np.stack([
        np.log1p(words.counts()), np.log1p(size), average, np.sqrt(np.maximum(mean(length**2) - average**2, 0)),
        *(share(KINDS[k]) for k in KINDS),
        _repeats(words.row, hashes, n), _repeats(words.row[:len(three)][three], windows(hashes, 3)[three], n),
        _repeats(lines.row, lines.hashes(), n),
        mean(length <= 3), mean(length >= 12), mean(KINDS["symbol"][last]), mean(KINDS["upper"][first]),
        mean(KINDS["upper"][first] & KINDS["upper"][second]), mean(KINDS["mark"][last]),
        np.log1p(lines.counts()), mean((length == 1) & KINDS["symbol"][first]),
    ], axis=1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        values = statistics(block.column(1))
        offsets = np.arange(0, values.size + 1, values.shape[1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [block.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))],
            names=["doc_id", "stats"])


class Kernel:
    """Random Fourier features of standardised statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.weights = rng.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.deviation, -6, 6)
        z = np.cos(x @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 1))


def _normal_equations(train: DataFrame, kernel: Kernel) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Z'Z, Z'y and rows of each fold: summed in partitions, then twice in groups of bounded size."""
    width = len(kernel.phase) + 1

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for fold in f["fold"].unique():
                own = f[f["fold"] == fold]
                z = kernel(_matrix(own["stats"]))
                part = z.T @ np.concatenate([z, own["y"].to_numpy(float)[:, None]], axis=1)
                sums[int(fold)] = sums.get(int(fold), 0) + part
        group = TaskContext.get().partitionId() % 64
        for fold, total in sums.items():
            yield pd.DataFrame({"fold": fold, "line": range(width), "part": group, "values": list(total)})

    def added(f: pd.DataFrame) -> pd.DataFrame:
        head = f.iloc[:1].copy()
        head.at[head.index[0], "values"] = np.sum(f["values"].to_list(), axis=0)
        return head

    schema = "fold int, line int, part int, values array<double>"
    parts = train.mapInPandas(local, schema)
    summed = parts.groupBy("fold", "line", "part").applyInPandas(added, schema) \
        .groupBy("fold", "line").applyInPandas(added, schema)
    out: dict[int, list] = {}
    for r in summed.orderBy("fold", "line").collect():  # folds x features rows
        out.setdefault(r["fold"], []).append(r["values"])
    return {fold: ((m := np.array(lines))[:, :-1], m[:, -1], float(m[-1, -2])) for fold, lines in out.items()}


def solve(parts: list[tuple[np.ndarray, np.ndarray, float]], ridge: float) -> np.ndarray:
    left, right, n = (sum(p[i] for p in parts) for i in range(3))
    penalty = np.eye(len(right)) * ridge * max(n, 1.0)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(left + penalty, right)


def isotonic(place: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit (pool adjacent violators), to interpolate between."""
    pools: list[list[float]] = []
    for x, y, w in zip(place, mean, weight):
        pools.append([x * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    total = np.array(pools)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


def fold_of(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)).cast("int")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", features: int = FEATURES, ridge: float = RIDGE,
                   width: float = WIDTH) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted (1 from `PREDICT_FROM` on).

    Learns from all labels 0 and 1 of documents whose fold (crc32 of the id, modulo 5) is not 0;
    other labels and null ids are passed over. Without labels every score is 0.5. Null texts count
    as empty, repeated rows are scored each, other columns are not carried.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = stored(rows.mapInArrow(_statistics, "doc_id long, stats array<double>"))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")) \
        .where("y IN (0, 1)").withColumn("fold", fold_of("doc_id")).where("fold <> 0")
    train = stored(stats.join(marks, "doc_id").select("fold", "y", "stats"))
    size = statistics(pa.array([""])).shape[1]
    moments = train.agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("stats", F.lit(i))) for i in range(size)]).alias("m"),
                        F.array(*[F.stddev_pop(F.get("stats", F.lit(i))) for i in range(size)]).alias("s")).first()
    held = F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out")
    if not moments["n"]:
        return stats.select("doc_id", held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    kernel = Kernel(np.array(moments["m"]), np.array(moments["s"]), features, width)
    parts = _normal_equations(train, kernel)
    final = solve(list(parts.values()), ridge)
    others = {fold: solve([p for f, p in parts.items() if f != fold] or list(parts.values()), ridge) for fold in parts}

    def outside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A histogram of the scores that models of the other folds give."""
        for f in frames:
            z = kernel(_matrix(f["stats"]))
            raw = np.einsum("ij,ij->i", z, np.stack([others[int(k)] for k in f["fold"]])) if len(f) else np.zeros(0)
            at = np.clip(np.round((raw + 0.5) / 2 * BINS), 0, BINS).astype(int)
            yield pd.DataFrame({"bin": at, "y": f["y"].to_numpy(float)}).groupby("bin", as_index=False) \
                .agg(n=("y", "size"), y=("y", "sum"))

    bins = train.mapInPandas(outside, "bin int, n long, y double").groupBy("bin") \
        .agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").toPandas()  # at most BINS + 1 rows
    knots, values = isotonic(bins["bin"].to_numpy(float), (bins["y"] / bins["n"]).to_numpy(), bins["n"].to_numpy(float))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = kernel(_matrix(f["stats"])) @ final if len(f) else np.zeros(0)
            value = np.clip(np.interp((raw + 0.5) / 2 * BINS, knots, values), 0.0, 1.0)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "score": value})

    return stats.mapInPandas(score, "doc_id long, score double") \
        .select("doc_id", held, "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
