"""The registered queries of this package and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from styloweave.llm import op01_html as pages
from styloweave.llm import op02_token_counts as token_counts
from styloweave.llm import op03_divergence as divergence
from styloweave.llm import op04_near_dedup as near
from styloweave.llm import op05_substring_dedup as substrings
from styloweave.llm import op06_masked_lm as masked
from styloweave.llm import op07_chat as chat
from styloweave.llm import op08_classifier as classifier
from styloweave.llm import op09_packing as packing
from styloweave.llm import op10_decontamination as decontamination
from styloweave.llm import op11_structure_repair as structure
from styloweave.llm import op12_merkle as merkle
from styloweave.llm import op13_config_packing as config_packing
from styloweave.llm import oracles, oracles_b

ORACLES = oracles.ORACLES | oracles_b.ORACLES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKENIZER = "word_bpe_49k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"),
                                          public_tokenizers.path(TOKENIZER))


@query
def op3_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.judge(table(spark, folder, "documents")).drop("char_distance", "word_distance")


@query
def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_classes(table(spark, folder, "documents")).select("doc_id", "class_id", "n_words")


@query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.report(substrings.removals(table(spark, folder, "documents")))


@query
def op6_masked_lm(spark: SparkSession, folder: str) -> DataFrame:
    return masked.pseudo_likelihood(table(spark, folder, "documents"))


@query
def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.report(chat.conversations(chat.threads(rows)))


@query
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(decontamination.matches(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query
def op11_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return structure.report(table(spark, folder, "conversations"))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.report(merkle.manifest(table(spark, folder, "documents"), tampered=merkle.tampering()))


@query
def op13_config_packing(spark: SparkSession, folder: str) -> DataFrame:
    return config_packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
