"""Comparison of two vector sets in long form (`doc_id, feature, value`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """`feature, side`: names only in A, only in B, or in both.

    Names are reduced to their distinct values before they meet.
    """
    def names(df, side):
        return df.select("feature").distinct().withColumn("s", F.lit(side))
    side = F.when(F.max("s") == "a", "a").when(F.min("s") == "b", "b").otherwise("both")
    return names(a, "a").unionByName(names(b, "b")).groupBy("feature").agg(side.alias("side"))


def overlap_by_prefix(a: DataFrame, b: DataFrame, separator: str = ":") -> DataFrame:
    """`prefix, only_a, only_b, both`: the overlap of names, by the part before the separator."""
    prefix = F.substring_index("feature", separator, 1)
    return column_overlap(a, b).groupBy(prefix.alias("prefix")).agg(
        *[F.count_if(F.col("side") == s).alias(n) for s, n in (("a", "only_a"), ("b", "only_b"), ("both", "both"))])


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Absolute difference per document and feature; a missing value is zero.

    The signed union needs one aggregation instead of a full outer join.
    """
    signed = a.select("doc_id", "feature", "value").unionByName(
        b.select("doc_id", "feature", (-F.col("value")).alias("value")))
    return signed.groupBy("doc_id", "feature").agg(F.abs(F.sum("value")).alias("diff"))


def difference_summary(a: DataFrame, b: DataFrame, atol: float = 1e-6,
                       cells: int | None = None) -> DataFrame:
    """Largest and mean difference, and how many exceed the tolerance.

    `cells` is the number of compared cells including those absent on both sides; by
    default only cells present on a side count.
    """
    n = F.lit(cells) if cells is not None else F.count("*")
    return _differences(a, b).agg(F.max("diff").alias("max_diff"),
                                  (F.sum("diff") / n).alias("mean_diff"),
                                  F.count_if(F.col("diff") > atol).alias("over"))


def most_different(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """The `k` features with the largest difference of any document."""
    return (_differences(a, b).groupBy("feature").agg(F.max("diff").alias("max_diff"))
            .orderBy(F.desc("max_diff"), "feature").limit(k))
