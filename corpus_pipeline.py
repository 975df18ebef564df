"""The corpus pipeline: stages over `documents`, each written as Parquet and read again.

Every stage but the last returns the columns of `documents`. Documents are kept whole or dropped by
the classifier, the near-duplicate stage and decontamination; substring deduplication changes texts
(and their n_chars). ORACLE_SQL is None: SQL can't express the tokenizer or the classifier; the
tests compare each stage with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styloweave.llm import op04_near_dedup as near
from styloweave.llm import op05_substring_dedup as substrings
from styloweave.llm import op08_classifier as classifier
from styloweave.llm import op09_packing as packing
from styloweave.llm import op10_decontamination as decontamination
from styloweave.llm.queries import TOKENIZER
from styloweave.llm.storage import stored, unused


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scores = classifier.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "kept_id")
    kept = scores.where("predicted = 1").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near.deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller id has."""
    return substrings.deduplicate(docs).withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    found = decontamination.report(decontamination.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    name = unused(docs, "bad_id")
    bad = found.where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("packing", harmonic_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents` of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
