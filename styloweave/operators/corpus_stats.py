"""Corpus statistics: counts, cross tables, group descriptions, variance, correlation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from styloweave.functions import labels as lb
from styloweave.functions import text as tx
from styloweave.operators import newton
from styloweave.session import kept


def with_metadata(docs: DataFrame) -> DataFrame:
    """`doc_id, text, model_full, model_category, text_type, word_count, text_length`."""
    model = lb.explored_model_of(F.col("doc_id"))
    return docs.select(
        "doc_id", "text", model.alias("model_full"),
        lb.explored_category_of(model).alias("model_category"),
        lb.text_type_of(F.col("doc_id")).alias("text_type"),
        tx.word_count(F.col("text")).alias("word_count"),
        tx.text_length(F.col("text")).alias("text_length"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def cross_table(df: DataFrame, rows: str, columns: str, values: list[str], rest: str = "other") -> DataFrame:
    """Counts of `rows` x `columns`, zero filled; column `rest` counts values not listed, and null."""
    listed = F.coalesce(F.col(columns).isin(values), F.lit(False))
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(v) for v in values],
                                F.count_if(~listed).alias(rest))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def describe_by(df: DataFrame, key: str, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per group.

    The quartiles count distinct values first, so the shuffle carries one row per value of
    a group and task, not its rows.
    """
    quartile = F.percentile(column, [0.25, 0.5, 0.75])
    return (df.groupBy(key).agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
        quartile.alias("q"), F.max(column).alias("max"))
        .select(key, "count", "mean", "std", "min", F.col("q")[0].alias("p25"),
                F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max"))


def summary(df: DataFrame, keys: list[str], column: str = "word_count") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
        F.max(column).alias("max"))


def chunk_counts(docs: DataFrame) -> DataFrame:
    """Human documents, and how many are first and second chunks."""
    is_chunk = {n: F.col("doc_id").contains(n) for n in ("chunk_1", "chunk_2")}
    return docs.agg(F.count_if(F.col("doc_id").contains("chunk")).alias("human"),
                    *[F.count_if(c).alias(n) for n, c in is_chunk.items()])


def pairwise_sizes(docs: DataFrame) -> DataFrame:
    """Human second chunks against the documents of each other category."""
    model = lb.explored_model_of(F.col("doc_id"))
    per = docs.groupBy(lb.explored_category_of(model).alias("llm")).agg(
        F.count("*").alias("n_llm"), F.count_if(F.col("doc_id").contains("chunk_2")).alias("c2"))
    # the window spans one row per category
    return per.withColumn("n_human", F.sum("c2").over(W.partitionBy())) \
        .where("llm <> 'human'").select("llm", "n_human", "n_llm")


def feature_variance(vectors: DataFrame, n_docs: int | None = None) -> DataFrame:
    """Sample variance per feature of sparse long vectors; absent values count as zero."""
    n = F.lit(n_docs if n_docs is not None else
              vectors.agg(F.count_distinct("doc_id")).first()[0]).cast("double")
    per = vectors.groupBy("feature", "item").agg(
        F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("*").alias("k"))
    # pooled with the zeros: between-part plus within-part
    k, m = F.col("k").cast("double"), F.col("m")
    squares = k * F.col("v") + k * m * m * (n - k) / n
    return per.select("feature", "item", (squares / (n - 1)).alias("variance")) \
        .orderBy(F.desc("variance"), "feature", "item")


def feature_correlation(vectors: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of all pairs of positions of `features`, as `a, b, r`; null beside a constant.

    Vectors are stored in blocks for three passes: means, deviations, and products of standardised columns. Products are summed
    in bands of the matrix by a tree of tasks; the matrix stays a table, and only one number a column
    reaches the driver.
    """
    width = len(names)
    rows = newton.in_few_tasks(kept(newton.blocked(newton.packed(vectors, F.lit(0.0), F.array(F.lit(newton.TRAIN))))))
    scale, means, n = newton.moments(rows, 1, width)
    scale, means, n = scale[0], means[0], int(n[0])

    def products(x, y, parts):
        z = (x[:, :width] - means) * scale
        yield 0, z.T @ z

    constant = np.isnan(scale)
    scale = np.where(constant, 0.0, scale)

    def cells(batches):
        for batch in batches:
            for band, payload in zip(batch.column("band").to_pylist(), batch.column("payload").to_pylist()):
                own = np.frombuffer(payload).reshape(-1, width)
                i, j = (x.ravel() + base for x, base in zip(np.indices(own.shape), (band, 0)))
                r = np.where(constant[i] | constant[j], np.nan, own.ravel() / max(n, 1))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                                  pa.array(r, pa.float64(), from_pandas=True)], names=["i", "j", "r"])

    by_ord = vectors.sparkSession.createDataFrame(list(enumerate(names)), "i int, name string")
    table = newton.summed_bands(rows, products, width).mapInArrow(cells, "i int, j int, r double")
    return table.join(F.broadcast(by_ord.withColumnRenamed("name", "a")), "i") \
        .join(F.broadcast(by_ord.toDF("j", "b")), "j").select("a", "b", "r")
