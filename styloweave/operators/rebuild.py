"""Documents from token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.functions import labels as lb
from styloweave.functions import text as tx
from styloweave.operators.sampling import first_per_class
from styloweave.session import checkpointed, pinned


def _joined_in_order(order: str, part: str) -> Column:
    pieces = F.sort_array(F.collect_list(F.struct(order, part)))
    return tx.repair_spacing(F.array_join(pieces[part], " "))


def rebuild_documents(tok: DataFrame) -> DataFrame:
    """`doc_id, text`: tokens to sentences, sentences to documents, spacing repaired.

    Tokens are grouped by sentence first, so a long document is put together from parts
    made in many tasks. The order of the input rows does not matter.
    """
    sentences = tok.groupBy("doc_id", "sentence_id").agg(
        _joined_in_order("token_id", "token").alias("s"))
    return sentences.groupBy("doc_id").agg(_joined_in_order("sentence_id", "s").alias("text"))


def rebuild_corpus(tok: DataFrame, limit_per_category: int | None = None,
                   arrival: str | None = None) -> DataFrame:
    """Documents of the corpus categories with their category.

    The limit is applied to document ids before any text is built. Without an arrival
    column, documents arrive in the order of a hash of their id.
    """
    category = lb.category_of(lb.model_of(F.col("doc_id")))
    kept = tok.withColumn("model_category", category).where(
        F.col("model_category").isin(fv.CORPUS_CATEGORIES))
    if limit_per_category is not None:
        arrived = F.min(arrival) if arrival else F.min(F.xxhash64("doc_id"))
        ids = checkpointed(kept.groupBy("doc_id", "model_category").agg(arrived.alias("arrived")))
        chosen = first_per_class(ids, "model_category", limit_per_category, "arrived")
        kept = kept.join(pinned(chosen.select("doc_id")), "doc_id", "left_semi")
    return rebuild_documents(kept).withColumn("model_category", category)


def category_counts(tok: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents per category, and how many a limit lets through."""
    ids = tok.select("doc_id").distinct()
    counted = ids.groupBy(lb.category_of(lb.model_of(F.col("doc_id"))).alias("model_category")) \
        .agg(F.count("*").alias("n_docs"))
    kept = counted.where(F.col("model_category").isin(fv.CORPUS_CATEGORIES))
    return kept.withColumn("n_written", F.least("n_docs", F.lit(limit)) if limit is not None
                           else F.col("n_docs"))
