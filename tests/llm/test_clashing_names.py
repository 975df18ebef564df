"""Stages on tables whose columns are named as their helpers, and other odd inputs."""

import pytest

import corpus_pipeline
from styloweave.llm import op04_near_dedup as near
from styloweave.llm import op05_substring_dedup as substrings
from styloweave.llm import op07_chat as chat
from styloweave.llm import op10_decontamination as decontamination
from styloweave.llm.storage import unused
from tests.llm import fixtures as fx

NAMES = ("__id", "__key", "__cut", "__text", "kept_text", "id", "key", "cut", "row", "kept_id", "bad_id", "class_id", "n_removed")


def odd(spark):
    passage = fx.prose(7, 400)
    rows = [(1, passage), (2, passage + " and a little more"), (3, "own words " + passage), (4, fx.prose(8, 300)), (None, "no id"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in NAMES], "'en' AS lang", "'s' AS source", "1L AS n_chars")


def own_values(row):
    return all(row[n] == (None if row["doc_id"] is None else f"{n}{row['doc_id']}") for n in NAMES)


@pytest.mark.parametrize("stage", [near.deduplicate, substrings.deduplicate])
def test_columns_of_any_name_stay(spark, stage):
    df = odd(spark)
    out = stage(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert all(map(own_values, rows)) and {r["doc_id"] for r in rows} >= {1, 4, None}


def test_pipeline_stages_keep_columns(spark):
    df = odd(spark)
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, folder)
        assert out.columns == df.columns and all(map(own_values, out.collect())), name


def test_unused_names(spark):
    assert unused(odd(spark), "ID") == "ID_" and unused(odd(spark), "free") == "free"


def test_repeated_items_count_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c")] * 500 + [(2, "b c")], "item_id long, text string")
    found = decontamination.report(decontamination.matches(docs, items, block_words=4)).collect()
    assert [(r["n_hit"], r["n_items"]) for r in found] == [(2, 2)]


def test_cycles_are_an_error(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "node string, parent string")
    with pytest.raises(ValueError):
        chat.tree_paths(nodes)
