"""Documents from a stream of token rows.

A document is complete when no token of it has arrived for `gap` and the watermark has
passed; a session window per document expresses just that, with state kept and spilled by
Spark's state store. Where each file holds whole documents, `rebuild_batches` needs no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from styloweave.functions import text as tx
from styloweave.operators.rebuild import rebuild_documents


def rebuild_stream(tokens: DataFrame, time_column: str = "ingested", gap: str = "10 minutes",
                   late: str = "10 minutes") -> DataFrame:
    """`doc_id, text, finished_at, n_tokens`, one row per finished document (append mode).

    Tokens of a document may arrive in any order within the gap. A longer pause ends the
    document and what follows makes another row; rows later than the watermark are left out.
    `reconciled` mends both from the stored tokens.
    """
    row = F.struct("sentence_id", "token_id", "token")
    done = (tokens.withWatermark(time_column, late)
            .groupBy("doc_id", F.session_window(time_column, gap).alias("w"))
            .agg(F.sort_array(F.collect_list(row)).alias("t")))
    # a mark before each first word of a sentence lets one join and one split find them all
    mark = "\x1e"
    words = F.transform("t", lambda x, i: F.concat(F.when(
        x.sentence_id != F.coalesce(F.get("t", i - 1).sentence_id, x.sentence_id),
        mark).otherwise(""), x.token))
    sentences = F.transform(F.split(F.array_join(words, " "), " " + mark), tx.repair_spacing)
    return done.select("doc_id", tx.repair_spacing(F.array_join(sentences, " ")).alias("text"),
                       F.col("w.end").alias("finished_at"), F.size("t").cast("long").alias("n_tokens"))


def reconciled(finished: DataFrame, tokens: DataFrame) -> DataFrame:
    """`doc_id, text`, one full row per document of `tokens`, the token table the stream was read from.

    Rows of the stream stand where one row holds all tokens of its document; documents in
    several parts, with late tokens or not finished yet are built from the table. Only ids
    and counts are compared, so texts of right documents are not built again.
    """
    parts = finished.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n_tokens"))
    there = tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    seen = there.join(parts, "doc_id", "left")
    right = (F.col("parts") == 1) & (F.col("n") == F.col("n_tokens"))
    whole = finished.join(seen.where(right).select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    wrong = tokens.join(seen.where(~F.coalesce(right, F.lit(False))).select("doc_id"), "doc_id", "left_semi")
    return whole.unionByName(rebuild_documents(wrong).select("doc_id", "text"))


def rebuild_batches(tokens: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Stateless variant for files of whole documents: the batch job on each micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # the batch number names the folder, so a repeated batch overwrites itself
        rebuild_documents(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (tokens.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_documents(docs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    return (docs.writeStream.outputMode("append").format("parquet").option("path", folder)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
