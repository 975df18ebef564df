"""Authorship models: scaling, logistic regression, prediction and reports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import ElementwiseProduct
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from styloweave.operators import newton


# ------------------------------------------------------------------------------- vectors
def model_vectors(profiles: DataFrame, width: int, keep: list[str] = ()) -> DataFrame:
    """`doc_id, features`: style profiles as vectors in their smaller (mostly sparse) form, by whole batches."""
    given = ["doc_id", *keep]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, values = batch.column(len(given)), batch.column(len(given) + 1)
            row = np.repeat(np.arange(len(idx)), np.diff(idx.offsets.to_numpy()))
            at, v = idx.flatten().to_numpy(), values.flatten().to_numpy()
            row, at, v = row[v != 0], at[v != 0], v[v != 0]
            n = np.bincount(row, minlength=len(idx))
            sparse = 1.5 * (n + 1) < width       # as Spark's own vectors are compressed
            dense = np.flatnonzero(~sparse)
            full = np.zeros((len(dense), width))
            place = np.cumsum(~sparse) - 1
            mine = ~sparse[row]
            full[place[row[mine]], at[mine]] = v[mine]
            size = np.where(sparse, n, width)
            held = np.empty(size.sum())
            of_sparse = np.repeat(sparse, size)
            held[of_sparse], held[~of_sparse] = v[~mine], full.ravel()
            bounds = np.concatenate(([0], np.cumsum(np.where(sparse, n, 0)))).astype(np.int32)
            indices = pa.ListArray.from_arrays(pa.array(bounds), pa.array(at[~mine], pa.int32()), mask=pa.array(~sparse))
            features = pa.StructArray.from_arrays(
                [pa.array(np.where(sparse, 0, 1), pa.int8()), pa.array(np.full(len(n), width), pa.int32(), mask=~sparse), indices,
                 pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(held))],
                names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(given))), features], names=[*given, "features"])

    schema = T.StructType([*(profiles.schema[c] for c in given), T.StructField("features", VectorUDT())])
    return profiles.select(*given, F.col("items.idx"), F.col("items.value")).mapInArrow(vectors, schema)


def array_vectors(df: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, array_to_vector(F.col(column).cast("array<double>")).alias("features"))


# ------------------------------------------------------------------------------- scaling
def scale_factors(train: DataFrame) -> list[float]:
    """One over the population deviation of each position; 1 for constant positions."""
    rows = newton.packed(train, F.lit(0.0), F.array(F.lit(newton.TRAIN)))
    return newton.factors(rows, 1, newton.width_of(train))[0][0].tolist()


def scale(df: DataFrame, factors: list[float], column: str = "features") -> DataFrame:
    """Multiply each position; zeros stay zeros, as nothing is centred."""
    product = ElementwiseProduct(scalingVec=Vectors.dense(factors), inputCol=column,
                                 outputCol="_scaled")
    return product.transform(df).drop(column).withColumnRenamed("_scaled", column)


def scale_long(vectors: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Dense long vectors divided by their population deviation per feature."""
    deviations = vectors.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    return (vectors.join(deviations, keys)
            .withColumn("scaled", F.col(value) / F.when(F.col("_sd") > 0, F.col("_sd"))
                        .otherwise(F.lit(1.0))).drop("_sd"))


# ------------------------------------------------------------------------------- models
def dot(vector: Column, weights: list[float], intercept: float) -> Column:
    """Intercept and weighted sum of a vector column, over its entries only."""
    v, w = F.unwrap_udt(vector), F.array(*[F.lit(float(x)) for x in weights])
    indices = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return F.aggregate(F.zip_with(indices, v["values"], lambda i, x: x * F.get(w, i)), F.lit(float(intercept)),
                       lambda t, x: t + x)


@dataclass
class AuthorshipModel:
    """A fitted model with its classes in alphabetical order; the second one is positive.

    `slope` is the largest slope of the penalised loss at `weights`, of scaled columns.
    """

    classes: list[str]
    factors: list[float]
    weights: list[float]
    intercept: float
    slope: float
    iterations: int

    def margin(self, column: str = "features") -> Column:
        """Side and distance of a vector as it was before scaling."""
        return dot(F.col(column), [f * w for f, w in zip(self.factors, self.weights)], self.intercept)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds `predicted`."""
        negative, positive = self.classes
        side = F.when(self.margin() > 0, positive).otherwise(negative)
        return df.withColumn("predicted", side).drop("features")

    def coefficients(self, spark, columns: list[tuple[str, str]]) -> DataFrame:
        """`feature, <positive>, <negative>, ord` by magnitude: opposite signs per class."""
        negative, positive = self.classes
        rows = [(f"{f}:{i}", float(c), -float(c), n) for n, ((f, i), c) in enumerate(zip(columns, self.weights))]
        schema = f"feature string, `{positive}` double, `{negative}` double, ord int"
        return spark.createDataFrame(rows, schema).orderBy(F.abs(positive).desc(), "ord")


def as_model(classes: list[str], fit: newton.Fit) -> AuthorshipModel:
    return AuthorshipModel(classes, fit.factors.tolist(), fit.weights.tolist(), fit.intercept, fit.slope, fit.iterations)


def two_classes(rows: DataFrame, label: str) -> list[str]:
    """The two labels in alphabetical order; anything else is an error."""
    found = [r[0] for r in rows.select(F.col(label).cast("string")).distinct().limit(3).collect()]
    if None in found:
        raise ValueError(f"column {label} has nulls; drop or label those rows")
    if len(found) != 2:
        raise ValueError(f"two classes are needed, found {sorted(found)}")
    return sorted(found)


def train_model(train: DataFrame, label: str = "author_id", c: float = 1.0, max_iter: int = 60,
                tol: float = 1e-7) -> AuthorshipModel:
    """L2 logistic regression with inverse strength `c` on scaled vectors, by Newton steps.

    Half the squared norm against `c` times the summed loss. Each step reads `train`, so store
    what is costly to make.
    """
    classes = two_classes(train, label)
    rows = newton.packed(train, F.col(label).cast("string") == classes[1], F.array(F.lit(newton.TRAIN)))
    fit, = newton.fit_many(rows, 1, newton.width_of(train), c, max_iter, tol)
    return as_model(classes, fit)


# ------------------------------------------------------------------------------- reports
def accuracy(actual: str, predicted: str) -> Column:
    return F.avg((F.col(actual) == F.col(predicted)).cast("double"))


def classification_report(df: DataFrame, actual: str = "author_id",
                          predicted: str = "predicted") -> DataFrame:
    """`class, precision, recall, f1, support` per class, then accuracy and averages.

    All rows follow from the confusion counts, one row per pair of classes.
    """
    return report_of(df.groupBy(F.col(actual).cast("string").alias("y"),
                                F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n")))


def report_of(confusion: DataFrame) -> DataFrame:
    """The report of confusion counts `y, p, n`. Undefined ratios are zero."""
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), hit.alias("tp"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("named")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("named")))).alias("s")) \
        .select("s.*")
    zero = F.lit(0.0)
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "named")])
    per = per.select(
        "class", F.coalesce(F.try_divide("tp", "named"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), zero).alias("recall"), "support", "tp",
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("named") + F.col("support")), zero)
        .alias("f1"))
    scores = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    right = F.sum("tp") / F.sum("support")
    averages = per.agg(
        F.struct(F.lit("accuracy").alias("class"), *[right.alias(s) for s in scores], total).alias("a"),
        F.struct(F.lit("macro avg").alias("class"), *[F.avg(s).alias(s) for s in scores], total)
        .alias("m"),
        F.struct(F.lit("weighted avg").alias("class"), *[
            (F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores], total)
        .alias("w"))
    rest = averages.select(F.explode(F.array("a", "m", "w")).alias("r")).select("r.*")
    return per.select("class", *scores, "support").unionByName(
        rest.select("class", *scores, "support"))


def as_percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def results_table(results: DataFrame) -> DataFrame:
    """Pairwise results with formatted accuracies beside the numbers."""
    return results.withColumns({"Training": as_percent(F.col("train_accuracy")),
                                "Test": as_percent(F.col("test_accuracy"))})
