"""Documents from a token stream by state keyed on the document, with end markers and timers.

A marker row (null token) tells how many tokens its document has; the document is put out once all
are there, however long the pauses and whatever the order of tokens and marker. A document whose
marker never comes is put out, as incomplete, when nothing of it has come for `patience` of event
time. The state of a finished document stays as a stone for as long again, so that repeated rows
don't open it anew.

State is one list entry for each document and micro-batch, in Spark's state store; a restart from
the checkpoint goes on where the last committed batch ended. Each call of the store costs more than a
document's rows, so a batch takes three of a document, and its timer stays as rows come: one that rings
early is set again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from styloweave.functions import text as tx

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "doc_id string, sentences array<string>, n_tokens long, complete boolean"


class Documents(StatefulProcessor):
    """Gathers one document's tokens."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "sentence array<int>, place array<int>, token array<string>")
        # tokens so far (repeats may count twice), tokens expected (-1: not known), put out, deadline
        self.status = handle.getValueState("status", "seen long, expected long, done boolean, deadline long")

    def _tokens(self) -> list[tuple]:
        """All tokens in order, each place once."""
        held = {(s, p): w for part in self.parts.get() for s, p, w in zip(*part)}
        return [(s, p, w) for (s, p), w in sorted(held.items())]

    def _row(self, key, tokens: list[tuple], complete: bool) -> pd.DataFrame:
        sentences: dict[int, list[str]] = {}
        for s, _, w in tokens:
            sentences.setdefault(s, []).append(w)
        return pd.DataFrame({"doc_id": [key[0]], "sentences": [[" ".join(s) for s in sentences.values()]],
                             "n_tokens": [len(tokens)], "complete": [complete]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.status.get()
        seen, expected, done, deadline = held if held is not None else (0, -1, False, -1)
        latest = 0
        for frame in rows:
            latest = max(latest, int(frame["at"].max()))
            marks = frame["ends"].dropna()
            if len(marks):
                expected = int(marks.iloc[-1])
            part = frame[frame["token"].notna()]
            if len(part) and not done:
                self.parts.appendValue((part["sentence_id"].astype(int).tolist(), part["token_id"].astype(int).tolist(),
                                        part["token"].tolist()))
                seen += len(part)
        deadline = max(latest + self.patience, deadline)
        if held is None:
            self.handle.registerTimer(deadline)
        if not done and 0 <= expected <= seen:
            tokens = self._tokens()
            seen = len(tokens)
            if seen >= expected:
                done = True
                self.parts.clear()
                if tokens:
                    yield self._row(key, tokens, True)
        self.status.update((seen, expected, done, deadline))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.status.get()
        if held is None:
            return
        seen, expected, done, deadline = held
        if deadline > max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()):
            self.handle.registerTimer(deadline)      # rows have come since
            return
        if done:                       # the stone goes
            self.status.clear()
            return
        tokens = self._tokens()
        self.parts.clear()
        self.handle.registerTimer(deadline + self.patience)
        self.status.update((len(tokens), expected, True, deadline + self.patience))
        if tokens:
            yield self._row(key, tokens, False)

    def close(self) -> None:
        pass


def documents(tokens: DataFrame, time_column: str = "ingested", late: str = "1 day",
              patience_seconds: int = 7 * 86_400) -> DataFrame:
    """`doc_id, text, n_tokens, complete`, one row per document (append mode).

    `tokens` is a stream with doc_id, sentence_id, token_id, token, `ends` (long: the number of the
    document's tokens on its marker row, else null) and an event time. Rows behind the watermark,
    `late` after the latest row, are dropped by Spark. Repeated rows count once.
    """
    rows = tokens.withWatermark(time_column, late).select(
        F.col("doc_id").cast("string").alias("doc_id"), "sentence_id", "token_id", "token",
        F.col("ends").cast("double").alias("ends"), F.unix_millis(time_column).alias("at"), time_column)
    put_out = rows.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=Documents(1000 * patience_seconds), outputStructType=OUT,
        outputMode="append", timeMode="eventTime")
    text = tx.repair_spacing(F.array_join(F.transform("sentences", tx.repair_spacing), " "))
    return put_out.select("doc_id", text.alias("text"), "n_tokens", "complete")


def write(docs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start the query that writes the documents; its state is kept in RocksDB, which keyed state needs."""
    spark: SparkSession = docs.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)       # a query keeps the settings that it started with
    try:
        return (docs.writeStream.outputMode("append").format("parquet").option("path", folder)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
