"""Headline timings as one JSON line.

BENCH_SF_DIR names the folder of input tables, BENCH_CPUS the local cores. Annotation is an
input of the engine, so annotated tokens are stored first; that and the warm-up are given beside
the others with the prefix `prepare_`. All else counts in the total.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.operators import counters, extended, modeling, rebuild, sampling, style, syntax
from styloweave.operators import tokens as tk
from styloweave.functions import fixed_values as fv
from styloweave.plans import flows
from styloweave.plans.registry import table
from styloweave.plans.style_queries import only
from styloweave.session import local_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    spent: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.time()
        out = run()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)

    # a fixed piece of compiled work, to tell a slow host from slow code
    timed("prepare_yardstick", lambda: spark.range(400_000_000, numPartitions=int(cpus) if cpus.isdigit() else 8)
          .agg(F.sum(F.xxhash64("id").bitwiseAND(F.lit(255)))))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    timed("prepare_warm_up", lambda: tk.tokenize(docs).limit(1000))
    timed("prepare_annotate", lambda: tk.annotate_fixture(docs).write.parquet(f"{work}/tokens"))
    tok = spark.read.parquet(f"{work}/tokens")

    lexical = only("func_words", "punctuation", "tokens", "num_tokens", "types", "sentence_count",
                   "transitions", "unique_transitions")
    full = style.default_config(letters=0)
    columns = style.vector_columns(full)

    timed("tokenize", lambda: tk.tokenize(docs))
    timed("lexical_vectors_from_text", lambda: style.sparse_long(
        style.vectorize(tk.tokenize(docs), config=lexical)))
    timed("function_words_from_text", lambda: style.sparse_long(
        style.vectorize(tk.tokenize(docs), config=only("func_words"))))
    timed("richness_from_text", lambda: extended.richness(extended.word_counts(tk.tokenize(docs))))
    timed("readability_from_text", lambda: extended.readability(tk.tokenize(docs)))
    timed("full_825_vectors_from_tokens", lambda: style.sparse_long(
        style.vectorize(tok, docs=docs, config=full)))
    timed("document_counters_from_tokens", lambda: counters.document_counters(
        tok, [n for n in counters.ALL if n not in counters.MAPS]))
    timed("constructions_from_tokens", lambda: syntax.construction_matches(tok))
    timed("rebuild_from_tokens", lambda: rebuild.rebuild_documents(tok))

    def vectors():
        profiles = style.vectorize(tok, docs=docs, config=full)
        langs = table(spark, folder, "documents").select(
            "doc_id", F.when(F.col("lang") == "en", "human").otherwise("gpt").alias("author_id"))
        modeling.model_vectors(profiles, len(columns)).join(langs, "doc_id") \
            .write.parquet(f"{work}/vectors")
    timed("vectors", vectors)
    stored = spark.read.parquet(f"{work}/vectors")
    timed("stratified_split", lambda: sampling.three_way_split(
        stored.select("doc_id", "author_id"), "author_id"))
    fitted = []
    timed("fit_on_stored_vectors", lambda: fitted.append(modeling.train_model(stored)))
    for n in (5, 10):
        timed(f"refit_on_top_{n}", lambda: modeling.train_model(flows.on_top_features(stored, fitted[0], n)) and None)

    models = F.get(F.array(*map(F.lit, fv.CORPUS_CATEGORIES[1:])), (F.col("doc_id") % 6).cast("int"))
    labelled = stored.withColumn("model_category", F.when(F.col("author_id") == "human", "human").otherwise(models)) \
        .withColumn("author_id", F.when(F.col("author_id") == "human", "human").otherwise("llm"))
    timed("pairwise_6_categories", lambda: flows.pairwise(labelled))
    timed("across_corpora", lambda: flows.across_corpora(labelled, labelled.sample(0.5, 1)))

    queries = {k: v for k, v in spent.items() if not k.startswith("prepare_")}
    n_docs = docs.count()
    print(json.dumps({
        "metric": "total_time", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "prepare": {k: v for k, v in spent.items() if k.startswith("prepare_")},
        "docs": n_docs, "docs_per_sec": {k: round(n_docs / v, 1) for k, v in queries.items()},
        "sf": Path(folder).name.removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
