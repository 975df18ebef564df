"""Registered queries on the small tables, beside their check SQL."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = ["e02_pos_bigrams", "e07_func_words", "e15_unique_transitions", "g58_stative", "h1_linear_tree",
        "j12_mattr", "l1_three_way", "c1_rebuild", "m2_optimum", "m7_pairwise", "c2_stream", "a12_stored_by_part",
        "j7_psycholinguistic", "j12_mtld", "h8_matches_ru", "a5_replicated", "a7_vocab_folder"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", name) for name in entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
