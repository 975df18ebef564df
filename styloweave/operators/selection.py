"""Feature selection: rank coefficients, group and filter vocabularies, restrict vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.functions import labels as lb
from styloweave.session import broadcast_if_small


def order_by_magnitude(coefs: DataFrame, column: str = "human") -> DataFrame:
    """Coefficient table by absolute value, largest first."""
    if column not in ("human", "gpt"):
        raise ValueError(f"column must be human or gpt, not {column!r}")
    return coefs.orderBy(F.abs(column).desc(), "ord")


def extremes(coefs: DataFrame, n: int = 10, column: str = "human") -> DataFrame:
    """The `n` largest and `n` smallest by absolute value, with their `side` and `place`.

    Each side is a top-n, which keeps `n` rows per task.
    """
    size, cols = F.abs(column), coefs.columns
    def side(name: str, *order):
        rows = coefs.orderBy(*order).limit(n)
        place = F.row_number().over(W.partitionBy().orderBy(*order))
        return rows.select(*cols, F.lit(name).alias("side"), place.alias("place"))
    return side("top", size.desc(), "ord").unionByName(side("bottom", size.asc(), F.desc("ord")))


def top_features(coefs: DataFrame, n: int, column: str = "human") -> DataFrame:
    """The `n` features of largest magnitude; ties go to the first in file order."""
    return coefs.orderBy(F.abs(column).desc(), "ord").limit(n)


def by_type(top: DataFrame, column: str = "human") -> DataFrame:
    """`type, items`: chosen items of each feature type, strongest first.

    The input is a top-n selection, so its groups are small.
    """
    parsed = top.select(lb.feature_type(F.col("feature")).alias("type"),
                        lb.feature_value(F.col("feature")).alias("item"),
                        (-F.abs(column)).alias("size"), "ord")
    return (parsed.where("type <> '' and item <> ''").groupBy("type")
            .agg(F.sort_array(F.collect_list(F.struct("size", "ord", "item"))).alias("s"))
            .select("type", F.col("s.item").alias("items")))


def filtered_vocab(vocab: DataFrame, chosen: DataFrame) -> DataFrame:
    """Vocabulary table reduced to the chosen items.

    `vocab` and `chosen` have `feature, item, ord`. Selectable features keep their chosen
    items only, or vanish without any; other features stay whole.
    """
    selectable = fv.SELECTABLE_VOCABS
    kept = vocab.where(~F.col("feature").isin(selectable))
    picked = chosen.where(F.col("feature").isin(selectable))
    return kept.unionByName(picked.select(*vocab.columns))


def feature_config(chosen: DataFrame) -> DataFrame:
    """`feature, enabled` over the configurable types: on where an item was chosen."""
    spark = chosen.sparkSession
    types = spark.createDataFrame([(t,) for t in fv.CONFIGURABLE_TYPES], "feature string")
    present = chosen.select("feature").distinct().withColumn("found", F.lit(1))
    return types.join(present, "feature", "left").select(
        "feature", F.coalesce("found", F.lit(0)).alias("enabled"))


def restrict_vectors(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """Long vectors of the chosen `feature, item` pairs."""
    return vectors.join(broadcast_if_small(chosen.select("feature", "item")), ["feature", "item"],
                        "left_semi")


def selected_vocabs(names: list[str]) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Vocabularies and config that count only the named `feature:item` columns.

    Counting with these keeps unselected items out of the shuffle altogether. Use it where
    denominators do not depend on the vocabulary (all but letters in batch mode).
    """
    vocabs: dict[str, list[str]] = {}
    for name in names:
        feature, colon, item = name.partition(":")
        if colon and feature in fv.STYLE_FEATURES:
            vocabs.setdefault(feature, []).append(item)
    return vocabs, {f: int(f in vocabs) for f in fv.STYLE_FEATURES}


def select_columns(df: DataFrame, names: list[str],
                   meta: list[str] = ("doc_id", "author_id")) -> tuple[DataFrame, list[str]]:
    """Wide vectors with metadata and the named columns, and the names that are missing."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    wanted = [c for c in meta if c in have] + [n for n in names if n in have]
    return df.select(*[F.col(f"`{c}`") for c in wanted]), missing


def numeric_columns(df: DataFrame, meta: list[str] = ("doc_id", "author_id")) -> DataFrame:
    """Numeric columns and the metadata."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kept = [c for c, t in df.dtypes if c in meta or t in numeric or t.startswith("decimal")]
    return df.select(*[F.col(f"`{c}`") for c in kept])
