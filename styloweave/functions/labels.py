"""Labels parsed from document ids and feature names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv


def binary_author(doc_id: Column) -> Column:
    """`human`, `gpt` or `unknown`, by what the id contains."""
    return (F.when(doc_id.contains("chunk"), "human")
            .when(doc_id.contains("gpt"), "gpt")
            .otherwise("unknown"))


def model_of(doc_id: Column) -> Column:
    """Model named in the id; human chunks keep their chunk number."""
    return (F.when(doc_id.contains("chunk_2"), "human_chunk_2")
            .when(doc_id.contains("chunk"), "human_chunk_1")
            .when(doc_id.contains("@"), F.split_part(doc_id, F.lit("@"), F.lit(2)))
            .otherwise("unknown"))


def explored_model_of(doc_id: Column) -> Column:
    """Variant of `model_of` that does not tell the human chunks apart."""
    return F.when(doc_id.contains("chunk"), "human").otherwise(model_of(doc_id))


def _by_rules(model: Column, start: Column) -> Column:
    for part, category in fv.MODEL_CATEGORY_RULES:
        start = start.when(model.contains(part), category)
    return start.otherwise("other")


def category_of(model: Column) -> Column:
    return _by_rules(model, F.when(model == "human_chunk_2", "human")
                     .when(model == "human_chunk_1", "human_chunk_1"))


def explored_category_of(model: Column) -> Column:
    return _by_rules(model, F.when(model == "human", "human"))


def text_type_of(doc_id: Column) -> Column:
    return F.split_part(doc_id, F.lit("_"), F.lit(1))


def with_category(df: DataFrame) -> DataFrame:
    """Category column; a human author wins over what the id says."""
    parsed = category_of(model_of(F.col("doc_id")))
    return df.withColumn("model_category",
                         F.when(F.col("author_id") == "human", "human").otherwise(parsed))


def with_author(df: DataFrame, include_models: list[str] | None = None) -> DataFrame:
    """Keep human second chunks and (chosen) model rows; label them `human` or `llm`."""
    kept = keep_classes(
        df.withColumn("model_category", category_of(model_of(F.col("doc_id")))), include_models)
    return kept.withColumn(
        "author_id", F.when(F.col("model_category") == "human", "human").otherwise("llm"))


def keep_classes(df: DataFrame, include_models: list[str] | None = None,
                 column: str = "model_category") -> DataFrame:
    category = F.col(column)
    kept = df.where(~category.isin(fv.DROPPED_CATEGORIES))
    if include_models is None:
        return kept
    return kept.where((category == "human") | category.isin(list(include_models)))


def feature_type(name: Column) -> Column:
    """Part of a feature name before the first colon; null without a colon."""
    return F.when(name.contains(":"), F.substring_index(name, ":", 1))


def feature_value(name: Column) -> Column:
    """Part of a feature name after the first colon; null without a colon."""
    return F.when(name.contains(":"), name.substr(F.instr(name, ":") + 1, F.length(name)))
