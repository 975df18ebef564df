"""Keyed streams: end markers, pauses, late and repeated rows, restarts, timers; vocabulary folders."""

import datetime as dt

import pytest

from styloweave.sources import readers as rd
from styloweave.sources import writers as wr
from styloweave.streaming import keyed_documents as kd

SCHEMA = "doc_id string, sentence_id int, token_id int, token string, ends long, ingested timestamp"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


@pytest.fixture
def feed(spark, tmp_path):
    class Feed:
        n = 0

        def put(self, *rows):
            Feed.n += 1
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={Feed.n}"))

        def run(self):
            source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
            docs = kd.documents(source, late="1 day", patience_seconds=7 * 86_400)
            kd.write(docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
            found = spark.read.schema(docs.schema).parquet(str(tmp_path / "out")).collect()
            return sorted(map(tuple, found))

    return Feed()


def mark(doc, n, hours):
    return (doc, None, None, None, n, at(hours))


def test_markers_pauses_restarts_and_timers(feed, spark):
    feed.put(("a", 0, 0, "Hi", None, at(0)), ("a", 0, 1, ".", None, at(0)), ("b", 0, 0, "One", None, at(0)), ("c", 0, 0, "No", None, at(0)))
    feed.put(mark("a", 3, 1), mark("b", 1, 5), ("b", 0, 0, "One", None, at(5)), mark("e", 0, 5))
    # b has all its tokens, one of them twice; a waits for its third
    assert feed.run() == [("b", "One", 1, True)]
    feed.put(("a", 1, 2, "Late", None, at(0.5)), ("b", 0, 0, "One", None, at(5)), ("d", 0, 0, "x", None, at(10)))
    assert feed.run() == [("a", "Hi. Late", 3, True), ("b", "One", 1, True)]
    feed.put(("z", 0, 0, "end", None, at(24 * 40)))
    feed.put(mark("z", 1, 24 * 40))
    # the timers of c and d, which got no marker; b stays one document
    assert feed.run() == [("a", "Hi. Late", 3, True), ("b", "One", 1, True), ("c", "No", 1, False),
                          ("d", "x", 1, False), ("z", "end", 1, True)]
    assert spark.conf.get(kd.STORE) != kd.ROCKS


def test_repeated_tokens_do_not_complete_a_document(feed):
    feed.put(mark("a", 2, 0), ("a", 0, 0, "x", None, at(0)), ("a", 0, 0, "x", None, at(0)))
    assert feed.run() == []
    feed.put(("a", 0, 0, "x", None, at(1)))
    assert feed.run() == []
    feed.put(("a", 0, 1, "y", None, at(1)))
    assert feed.run() == [("a", "x y", 2, True)]


def test_vocabulary_folder_keeps_order(spark, tmp_path):
    wr.write_vocabs(spark, {"x": ["b", "a", "", " b ", "ä"], "y": ["c"], "z": []}, str(tmp_path / "v"))
    assert rd.vocab_lists(rd.read_vocabs(spark, str(tmp_path / "v"))) == {"x": ["b", "a", "ä"], "y": ["c"]}


def test_a_timer_that_rings_early_is_set_again(feed):
    feed.put(("c", 0, 0, "No", None, at(0)), ("d", 0, 0, "x", None, at(0)))
    feed.run()
    feed.put(("c", 0, 1, "end", None, at(24 * 5)))
    feed.run()
    feed.put(("z", 0, 0, "z", None, at(24 * 9)))       # the watermark passes the first deadline of c and d
    assert feed.run() == [("d", "x", 1, False)]
    feed.put(mark("c", 3, 24 * 9), ("c", 0, 2, ".", None, at(24 * 9)))
    assert feed.run() == [("c", "No end.", 3, True), ("d", "x", 1, False)]


def test_stream_parts_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from styloweave.plans import stream_queries as st
    rows = [(c, t, "user", f"Turn {t}. So it is, in {c}.") for c in range(4) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3) \
        .write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(st, "fresh_folder", lambda _: str(tmp_path / "work"))
    spark.conf.set("spark.sql.files.openCostInBytes", "4m")
    try:
        found = {r["doc_id"]: r["text"] for r in st.stream(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == {c * 1000 + t: text for c, t, _, text in rows}
    for part in (1, 2, 3, 4):
        assert len(list((tmp_path / "work" / "tokens" / f"part={part}").glob("*.parquet"))) > 1
