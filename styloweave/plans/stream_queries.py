"""Queries of the token stream and of the vocabulary folder as sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from styloweave.operators import tokens as tk
from styloweave.plans.corpus_queries import _REBUILD
from styloweave.plans.oracle_sql import tokens_cte, values_table
from styloweave.plans.registry import query, table
from styloweave.plans.style_queries import VOCABS
from styloweave.session import fresh_folder
from styloweave.sources import readers as rd
from styloweave.sources import writers as wr
from styloweave.streaming import keyed_documents as kd
from styloweave.streaming import rebuild_stream as rs

_TURNS = tokens_cte("SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations")
_BUILT = f"WITH {_TURNS}, {_REBUILD} SELECT doc_id, text FROM built"
EMPTY = {"lemma": "string", "pos": "string", "tag": "string", "head_token_id": "int", "dep": "string"}


def _tokens(spark, folder):
    """Token rows of the turns of `conversations`, each a second after the one before."""
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return tk.tokenize(turns).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("sentence_id").cast("int").alias("sentence_id"),
        F.col("token_id").cast("int").alias("token_id"), "token",
        *[F.lit(None).cast(kind).alias(c) for c, kind in EMPTY.items()],
        F.timestamp_add("SECOND", (F.col("doc_id") % 36_000).cast("int"), start).alias("ingested"))


@query("a8_stream_tokens", f"""WITH {_TURNS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(sentence_id AS INTEGER) AS sentence_id,
  CAST(token_id AS INTEGER) AS token_id, token FROM tok""")
def token_stream(spark, folder):
    """The stream source, written through as it comes, file by file."""
    work = fresh_folder(spark)
    _tokens(spark, folder).repartition(3, "doc_id").write.parquet(f"{work}/in")
    stream = rd.stream_tokens(spark, f"{work}/in", files_per_trigger=1)
    (stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{work}/out").select("doc_id", "sentence_id", "token_id", "token")


@query("c2_stream", _BUILT)
def stream(spark, folder):
    """Documents by keyed state: several micro-batches, a pause, late rows, and a restart.

    Odd tokens come two hours after the even ones, with the markers. The query is stopped there, and
    goes on from its checkpoint with every seventh token, late by up to two hours, and repeated rows.
    """
    work, tok = fresh_folder(spark), _tokens(spark, folder)
    later = F.col("ingested") + F.expr("INTERVAL 2 HOURS")
    number = F.lit(None).cast("long").alias("ends")
    late = F.col("token_id") % 7 == 3
    marks = tok.groupBy("doc_id").agg(F.count("*").alias("ends"), F.max("ingested").alias("ingested"))
    marks = marks.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("sentence_id", "int"), ("token_id", "int"), ("token", "string"), *EMPTY.items())], later.alias("ingested"), "ends")
    even, odd = tok.where(~late & (F.col("token_id") % 2 == 0)), tok.where(~late & (F.col("token_id") % 2 == 1))

    # as many files a part as tasks read the turns; a micro-batch takes that many
    files = max(1, table(spark, folder, "conversations").rdd.getNumPartitions())

    def put(df, part):
        df.coalesce(files).write.parquet(f"{work}/tokens/part={part}")

    def run():
        source = rd.stream_tokens(spark, f"{work}/tokens/part=*", files_per_trigger=files, more="ends long")
        kd.write(kd.documents(source), f"{work}/documents", f"{work}/state").awaitTermination()

    put(even.select("*", number), 1)
    put(odd.withColumn("ingested", later).select("*", number).unionByName(marks), 2)
    run()
    put(tok.where(late).select("*", number), 3)
    put(tok.where("token_id = 0").withColumn("ingested", later).select("*", number), 4)
    run()
    return spark.read.schema("doc_id string, text string, n_tokens long, complete boolean") \
        .parquet(f"{work}/documents").where("complete").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


@query("c2_reconciled", _BUILT)
def reconciled(spark, folder):
    """Session windows that pauses have torn, mended from the stored tokens."""
    work, tok = fresh_folder(spark), _tokens(spark, folder)
    torn = tok.withColumn("ingested", F.when(F.col("token_id") % 5 == 4, F.col("ingested") + F.expr("INTERVAL 2 HOURS"))
                          .otherwise(F.col("ingested")))
    torn.write.parquet(f"{work}/tokens/part=1")
    source = rd.stream_tokens(spark, f"{work}/tokens/part=*")
    docs = rs.rebuild_stream(source, "ingested", "10 minutes", "10 minutes")
    rs.write_documents(docs, f"{work}/documents", f"{work}/state").awaitTermination()
    finished = spark.read.schema(docs.schema).parquet(f"{work}/documents")
    return rs.reconciled(finished, spark.read.parquet(f"{work}/tokens/part=1")) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")


_WORDS = [(f, w, n) for f in sorted(VOCABS) for n, w in enumerate(dict.fromkeys(VOCABS[f]))]


@query("a7_vocab_folder", f"""WITH {tokens_cte()}, v(feature, item, ord) AS (VALUES {values_table(_WORDS)}),
n AS (SELECT token, count(*) AS n FROM tok GROUP BY token)
SELECT feature, item, CAST(ord AS INTEGER) AS ord, coalesce(n, 0) AS n FROM v LEFT JOIN n ON n.token = v.item""")
def vocab_folder(spark, folder):
    """Every vocabulary, written as a folder of word lists and read back, with its words' counts in `documents`."""
    work = fresh_folder(spark)
    wr.write_vocabs(spark, {f: [*words, "", *words[:1]] for f, words in VOCABS.items()}, work)
    held = rd.read_vocabs(spark, work)
    counts = tk.tokenize(table(spark, folder, "documents").select("doc_id", "text")).groupBy("token") \
        .agg(F.count("*").alias("n"))
    return held.join(counts, held["item"] == counts["token"], "left") \
        .select("feature", "item", "ord", F.coalesce("n", F.lit(0)).alias("n"))
