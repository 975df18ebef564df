"""Trees of tokens that lie in order, without a shuffle."""

from pyspark.sql import functions as F

from styloweave.operators import extended as ex
from styloweave.operators import syntax
from styloweave.operators import tokens as tk
from styloweave.plans.style_queries import fixture_shapes, fixture_trees

TEXTS = [(1, "He said ... that, it was so -- far away! And then?? \"The end.\""), (2, "One"), (3, None), (4, ""),
         (5, ", " * 40 + "word - - x. " + "long words of a sentence " * 60 + "."), (6, "\U0001D400bc Éa 12 a1 it's. of")]


def rows(df):
    return sorted(df.collect(), key=repr)


def documents(spark, more=()):
    return spark.createDataFrame([*TEXTS, *more], "doc_id long, text string")


def test_trees_in_order_are_the_trees_of_the_grouped_table(spark):
    tok = tk.annotate_fixture(documents(spark))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")     # sentences cross batches
    try:
        assert rows(syntax.ordered_trees(tok)) == rows(syntax.linear_trees(tok))
        assert rows(ex.tree_measures(tok, syntax.ordered_shapes(tok))) == rows(ex.tree_measures(tok))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trees_of_documents_need_no_shuffle(spark):
    plan = fixture_trees(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_repeated_and_null_ids_meet_as_in_the_grouped_table(spark):
    docs = documents(spark, [(1, "She is here. Or not."), (None, "No id."), (None, "None. At all.")])
    tok = tk.annotate_fixture(docs)
    assert rows(fixture_trees(docs)) == rows(syntax.linear_trees(tok))
    assert rows(ex.tree_measures(tok, fixture_shapes(docs))) == rows(ex.tree_measures(tok))


def test_heads_and_classes_of_marks_and_capitals(spark):
    tok = tk.annotate_fixture(documents(spark)).where("doc_id in (1, 6)").orderBy("doc_id", "token_id").collect()
    first = [r for r in tok if r.doc_id == 1 and r.sentence_id == 1]
    assert [r.token for r in first] == ["that", ",", "it", "was", "so", "-", "-", "far", "away", "!"]
    start = first[0].token_id
    assert [r.head_token_id - start for r in first] == [0, 0, 0, 2, 3, 4, 4, 4, 7, 8]
    assert [r.pos for r in tok if r.doc_id == 6] == ["NOUN", "PROPN", "NUM", "NOUN", "NOUN", "PUNCT", "ADP"]


def test_annotation_compiles_to_methods_that_the_jvm_compiles(spark):
    """Methods of more than 8,000 bytes of code stay interpreted."""
    plan = tk.annotate_fixture(documents(spark))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    assert all(int(str(stages.apply(i)._3()).split("(")[1].split(",")[0]) < 8000 for i in range(stages.size()))


def test_annotation_of_nothing(spark):
    assert tk.annotate_fixture(documents(spark)).where(F.col("doc_id").isin(3, 4)).count() == 0
