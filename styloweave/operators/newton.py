"""Many logistic regressions in one optimisation, to a slope of about zero.

A row may belong to several models at once, as human texts do when each model category is set
against them. `parts` tells for each model whether a row is absent (0), trains it (1) or tests it
(2). One pass over the rows gives the loss, slope and Hessian of all models at their present
weights: each task sums its own rows, in blocks of dense rows, and the sums meet in a tree of
bounded fan-in, so nothing but (width + 1)^2 numbers a model reaches the driver. Newton steps with
step halving follow until the largest slope vanishes; that slope is each fit's certificate, as the
penalised loss has one minimum. Widths are of some hundreds to a few thousand columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloweave.session import kept

ABSENT, TRAIN, TEST = 0, 1, 2
ROWS = 2_048         # of a dense block
BAND = 256           # rows of a Hessian in one record
FAN_IN = 32
SUMS = "model int, band int, part int, payload binary"
#: Bytes of a block of packed rows, and their types.
BLOCK = {"sizes": np.int32, "indices": np.int32, "values": np.float64, "y": np.float64, "parts": np.int32}


@dataclass
class Fit:
    """Weights of scaled columns; `slope` is the largest slope of the penalised loss there."""

    factors: np.ndarray
    weights: np.ndarray
    intercept: float
    n: int
    slope: float
    iterations: int


def packed(rows: DataFrame, y: Column, parts: Column, keep: list[str] = ()) -> DataFrame:
    """`indices, values, y, parts` of vectors, sparse or dense."""
    v = F.unwrap_udt("features")
    return rows.select(
        F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)).alias("indices"),
        v["values"].alias("values"), y.cast("double").alias("y"), parts.cast("array<int>").alias("parts"), *keep)


def width_of(rows: DataFrame) -> int:
    """Length of the vectors; 0 for an empty table."""
    v = F.unwrap_udt("features")
    row = rows.select(F.coalesce(v["size"], F.size(v["values"])).alias("n")).first()
    return row["n"] if row else 0


def _dense(batches: Iterator[pa.RecordBatch], width: int,
           columns: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(X with a column of ones, y, parts) of blocks of rows; of `columns` alone, if given."""
    place = None
    if columns is not None:
        place = np.full(width, -1)
        place[columns], width = np.arange(len(columns)), len(columns)
    for sizes, at, v, y, parts in _blocks(batches):
        x = np.zeros((len(sizes), width + 1))
        x[:, width] = 1.0
        row = np.repeat(np.arange(len(sizes)), sizes)
        if place is not None:
            at = place[at]
            row, at, v = row[at >= 0], at[at >= 0], v[at >= 0]
        x[row, at] = v
        yield x, y, parts.reshape(len(sizes), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(entries of each row, indices, values, y, parts) of blocks of packed rows, stored as such or not."""
    for batch in batches:
        if batch.schema.names[0] == "sizes":
            for held in zip(*(c.to_pylist() for c in batch.columns)):
                yield tuple(np.frombuffer(h, t) for h, t in zip(held, BLOCK.values()))
            continue
        for at in range(0, batch.num_rows, ROWS):
            own = batch.slice(at, ROWS)
            indices = own.column(0)
            yield (np.diff(indices.offsets.to_numpy()), indices.flatten().to_numpy(), own.column(1).flatten().to_numpy(),
                   own.column(2).to_numpy(zero_copy_only=False), own.column(3).flatten().to_numpy(zero_copy_only=False))


def blocked(rows: DataFrame) -> DataFrame:
    """Packed rows as bytes, a block of them in a row: what many passes read at little cost."""
    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in zip(own, BLOCK.values())],
                                             names=list(BLOCK))

    return rows.select("indices", "values", "y", "parts").mapInArrow(packs, ", ".join(f"{c} binary" for c in BLOCK))


def in_few_tasks(blocks: DataFrame, rows: int = 50_000) -> DataFrame:
    """Stored blocks in tasks of at most some `rows` rows, unless the cores ask for more: a task's start costs more than a block."""
    n = blocks.agg(F.sum(F.octet_length("sizes"))).first()[0] or 0
    tasks = max(2 * blocks.sparkSession.sparkContext.defaultParallelism, n // 4 // rows + 1)
    return blocks.coalesce(tasks) if blocks.rdd.getNumPartitions() > tasks else blocks


def summed_bands(rows: DataFrame, per_block, width: int, columns: np.ndarray | None = None) -> DataFrame:
    """Sum over all rows of `per_block(x, y, parts)`, a matrix for each model, by a tree of tasks.

    One row for each model and band of `BAND` matrix rows. `columns` are those of `x`, all by default.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x, y, parts in _dense(batches, width, columns):
            for model, m in per_block(x, y, parts):
                total[model] = total[model] + m if model in total else m
        for model, m in total.items():
            for band in range(0, len(m), BAND):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([model], pa.int32()), pa.array([band], pa.int32()),
                     pa.array([TaskContext.get().partitionId()], pa.int32()),
                     pa.array([np.ascontiguousarray(m[band:band + BAND]).tobytes()], pa.binary())],
                    names=["model", "band", "part", "payload"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(len(frame["payload"].iloc[0]) // 8)
        for payload in frame["payload"]:
            held += np.frombuffer(payload)
        return frame.iloc[:1].assign(payload=[held.tobytes()])[["model", "band", "part", "payload"]]

    sums, left = rows.mapInArrow(local, SUMS), rows.rdd.getNumPartitions()
    while left > 1:
        sums = sums.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        sums = sums.groupBy("model", "band", "part").applyInPandas(add, SUMS)
        left = -(-left // FAN_IN)
    return sums


def _summed(rows: DataFrame, per_block, shapes: dict[int, tuple[int, int]], width: int,
            columns: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """The summed matrices, on the driver."""
    sums = summed_bands(rows, per_block, width, columns)
    out = {model: np.zeros(shape) for model, shape in shapes.items()}
    for r in sums.collect():
        own = np.frombuffer(r["payload"]).reshape(-1, out[r["model"]].shape[1])
        out[r["model"]][r["band"]:r["band"] + len(own)] += own
    return out


def moments(rows: DataFrame, models: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One over the population deviation of each model's training rows (NaN for constants), means, and number of rows.

    Two passes, so that constants don't drown in rounding.
    """
    def sums(x, y, parts):
        for k in range(models):
            yield k, x[parts[:, k] == TRAIN].sum(0, keepdims=True)

    shapes = {k: (1, width + 1) for k in range(models)}
    first = _summed(rows, sums, shapes, width)
    n = np.array([first[k][0, width] for k in range(models)])
    means = np.array([first[k][0, :width] / max(n[k], 1) for k in range(models)])

    def squares(x, y, parts):
        for k in range(models):
            away = x[parts[:, k] == TRAIN][:, :width] - means[k]
            yield k, np.concatenate([(away ** 2).sum(0), [0.0]])[None]

    second = _summed(rows, squares, shapes, width)
    deviation = np.array([np.sqrt(second[k][0, :width] / max(n[k], 1)) for k in range(models)])
    constant = deviation <= 1e-12 * np.abs(means)
    return np.where(constant, np.nan, 1.0 / np.where(constant, 1.0, deviation)), means, n.astype(int)


def factors(rows: DataFrame, models: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One over the population deviation of each model's training rows, 1 for constant columns, and number of rows."""
    scale, _, n = moments(rows, models, width)
    return np.where(np.isnan(scale), 1.0, scale), n


def fit_many(rows: DataFrame, models: int, width: int, c: float = 1.0, max_iter: int = 60,
             tol: float = 1e-7) -> list[Fit]:
    """Fit all models together on packed `rows`, which are stored in blocks, as each step reads them.

    The penalty is half the squared norm of the scaled weights, the loss is summed and times `c`; the intercept is free.
    A model without training rows has zero weights. So has a column that is zero in all training rows, as only the
    penalty sees it; the steps are taken without such columns.
    """
    rows = in_few_tasks(kept(blocked(rows)))
    scale, means, n = moments(rows, models, width)
    columns = np.flatnonzero(((means != 0) | ~np.isnan(scale)).any(0))
    scale = np.where(np.isnan(scale), 1.0, scale)
    all_scales, all_columns, width = scale, width, len(columns)
    wide = np.concatenate([scale[:, columns], np.ones((models, 1))], 1)
    w = np.zeros((models, width + 1))
    penalty = np.concatenate([np.ones(width), [0.0]])

    def evaluate(at: np.ndarray, active: list[int]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        v = at * wide

        def per_block(x, y, parts):
            for k in active:
                mine = parts[:, k] == TRAIN
                if mine.any():
                    own, label = x[mine], y[mine]
                    z = own @ v[k]
                    p = np.exp(-np.logaddexp(0, -z))
                    loss = np.zeros(own.shape[1])
                    loss[0] = (np.logaddexp(0, z) - label * z).sum()
                    half = own * np.sqrt(p * (1 - p))[:, None]      # a product with itself takes half the work
                    yield k, np.vstack([loss, own.T @ (p - label), half.T @ half])

        found = _summed(rows, per_block, {k: (width + 3, width + 1) for k in active}, all_columns, columns)
        out = {}
        for k in active:
            m = found[k]
            out[k] = (c * m[0, 0] + 0.5 * (penalty * at[k] ** 2).sum(), c * m[1] * wide[k] + penalty * at[k],
                      c * m[2:] * np.outer(wide[k], wide[k]) + np.diag(penalty + (penalty == 0) * 1e-12))
        return out

    active = [k for k in range(models) if n[k]]
    state, step, slopes, used = {}, np.zeros_like(w), np.zeros(models), np.zeros(models, int)
    trial = w.copy()
    for _ in range(max_iter):
        found = evaluate(trial, active)
        for k in list(active):
            loss, slope, hessian = found[k]
            used[k] += 1
            if k in state and loss > state[k] + 1e-10 * max(1.0, abs(state[k])):
                step[k] /= 2
                trial[k] = w[k] + step[k]
                continue
            state[k], w[k], slopes[k] = loss, trial[k], np.abs(slope).max()
            if slopes[k] <= tol * max(1.0, 1e-6 * c * n[k]):
                active.remove(k)
                continue
            step[k] = -np.linalg.solve(hessian, slope)
            trial[k] = w[k] + step[k]
        if not active:
            break
    weights = np.zeros((models, all_columns))
    weights[:, columns] = w[:, :width]
    return [Fit(all_scales[k], weights[k], float(w[k, width]), int(n[k]), float(slopes[k]), int(used[k]))
            for k in range(models)]


def confusions(rows: DataFrame, fits: list[Fit], width: int) -> DataFrame:
    """`model, part, y, p, n`: counts of label and prediction in each model's parts, in one pass."""
    v = np.array([np.concatenate([f.factors * f.weights, [f.intercept]]) for f in fits])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(fits), 3, 2, 2), np.int64)
        for x, y, parts in _dense(batches, width):
            sides = (x @ v.T > 0).astype(int)
            for k in range(len(fits)):
                np.add.at(held[k], (parts[:, k], y.astype(int), sides[:, k]), 1)
        held[:, ABSENT] = 0
        at = np.argwhere(held)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(at[:, i], pa.int32()) for i in range(4)), pa.array(held[tuple(at.T)], pa.int64())],
            names=["model", "part", "y", "p", "n"])

    counted = rows.select("indices", "values", "y", "parts").mapInArrow(count, "model int, part int, y int, p int, n long")
    return counted.groupBy("model", "part", "y", "p").agg(F.sum("n").alias("n"))
