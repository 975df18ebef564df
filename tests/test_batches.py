"""Annotation, trees and counts of whole batches."""

from collections import Counter

from pyspark.sql import functions as F

from styloweave.operators import extended, style, syntax
from styloweave.operators import tokens as tk

TEXTS = [(1, "The dog, who walked (far), was killed. . It is 12! "), (2, None), (3, "  \n"), (4, ""),
         (5, "?! Running is what \u00c9lan likes. \u0130stanbul, \u4e2d x"), (6, "... a b c")]


def _docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_chosen_columns_are_those_of_the_whole_annotation(spark):
    whole = tk.annotate_fixture(_docs(spark))
    for columns in (["lemma"], ["sent_pos", "token", "dep"], ["token_id", "head_token_id", "next_pos"]):
        few = tk.annotate_fixture(_docs(spark), columns=columns)
        assert set(few.columns) == {"doc_id", *columns}
        assert Counter(few.collect()) == Counter(whole.select(few.columns).collect())


def test_trees_made_with_the_annotation(spark):
    expected = syntax.linear_trees(tk.annotate_fixture(_docs(spark))).collect()
    assert sorted(tk.annotated_trees(_docs(spark)).collect()) == sorted(expected)


def test_a_document_over_several_batches_keeps_its_places(spark):
    docs = spark.createDataFrame([(1, "It is. We go on. They ran; she left! " * 5), (2, "One. Two three.")],
                                 "doc_id long, text string")
    expected = sorted(tk.annotate_fixture(docs).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(tk.annotate_fixture(docs.coalesce(1)).collect()) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_batches_count_items_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None), (1, "b")], "doc_id long, token string").coalesce(1)
    found = style.counted_by_batch(rows, [("w", F.col("token")), ("all", F.lit(style.UNLISTED))]).collect()
    assert Counter(map(tuple, found)) == Counter([
        (1, "w", "a", 2), (None, "w", "a", 1), (1, "w", "b", 1), (1, "all", None, 3), (None, "all", None, 1), (2, "all", None, 1)])


def test_surface_annotates_once(spark):
    df = extended.surface(_docs(spark), tk.annotate_fixture(_docs(spark), columns=["sent_pos", "token", "lemma"]))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2     # annotation, counts
    row = {r["doc_id"]: r for r in df.collect()}[6]
    assert (row["n_tokens"], row["n_types"], row["n_lemmas"], row["n_sentences"]) == (6, 4, 4, 2)
