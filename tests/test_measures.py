"""Stored parts, correlations, lexicons of several measures, the planner and trees against plain versions."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from styloweave.operators import corpus_stats as cs
from styloweave.operators import extended as ex
from styloweave.operators import extended_plan as xp
from styloweave.operators import lexicon as lx
from styloweave.operators import syntax
from styloweave.operators import tokens as tk
from styloweave.sources import materialise as mt


def test_only_new_or_changed_files_are_computed(spark, tmp_path):
    def put(name, *rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in" / f"f={name}"))

    seen = []

    def count(new):
        seen.append(sorted(r["doc_id"] for r in new.collect()))
        return new.select("part_key", "doc_id", F.length("text").alias("n"))

    def stored(config=None):
        parts = mt.get_or_compute_parts(spark, str(tmp_path / "out"), str(tmp_path / "in"), config or {"a": 1}, count)
        return sorted((r["doc_id"], r["n"]) for r in parts.rows.collect()), parts.new, parts.kept

    put("a", (1, "x"), (2, "yy"))
    assert stored() == ([(1, 1), (2, 2)], 1, 0)
    put("b", (3, "zzz"))
    assert stored() == ([(1, 1), (2, 2), (3, 3)], 1, 1)
    assert stored() == ([(1, 1), (2, 2), (3, 3)], 0, 2) and seen == [[1, 2], [3]]
    put("a", (1, "changed"))
    assert stored() == ([(1, 7), (3, 3)], 1, 1) and seen[-1] == [1]
    assert stored({"a": 2})[1:] == (2, 0)     # another configuration


def test_correlation_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 300)) * (rng.random((200, 300)) < 0.3)
    x[:, 1] = 2 * x[:, 0] + 1
    x[:, 2] = 4.0
    rows = [(i, Vectors.dense(r.tolist()) if i % 2 else Vectors.sparse(300, {int(j): float(r[j]) for j in np.flatnonzero(r)}))
            for i, r in enumerate(x)]
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame(rows, ["doc_id", "features"]).repartition(5)
    got = {(r["a"], r["b"]): r["r"] for r in cs.feature_correlation(df, names).collect()}
    with np.errstate(invalid="ignore"):
        exact = np.corrcoef(x.T)
    assert len(got) == 300 * 300
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if 2 in (i, j):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(exact[i, j], abs=1e-9)


def test_several_measures_equal_single_ones(spark, tokens):
    tok = tokens({"a": [["Good", "bad", "good", "odd"]], "b": [["odd"]], "c": [["none"]]})
    lexicon = spark.createDataFrame([("good", 6.0, 0.5, 1.0), ("bad", 1.0, None, None), ("odd", None, 2.0, 4.0)],
                                    "key string, emotion_intensity double, sd_aoa double, aoa double")
    got = lx.lexicon_measures(tok, lexicon, {"emotion_intensity": (2, 5), "aoa": (2, 3, 1)})
    assert got.columns[1:] == lx.lexicon_columns({"emotion_intensity": (2, 5), "aoa": (2, 3, 1)})
    got = {r["doc_id"]: r.asDict() for r in got.collect()}
    one = {r["doc_id"]: r for r in lx.lexicon_features(tok, lexicon.selectExpr("key", "aoa AS value", "sd_aoa AS sd"), "aoa", low=2, high=3, max_sd=1).collect()}
    for doc, row in got.items():
        assert {k: row[k] for k in one[doc].asDict()} == one[doc].asDict()
    assert got["a"]["avg_emotion_intensity"] == pytest.approx(13 / 3) and got["a"]["n_high_intensity"] == 2
    assert got["b"]["avg_emotion_intensity"] is None and got["c"]["n_low_aoa"] == 0


def test_planner_equals_single_functions(spark):
    docs = spark.createDataFrame([("a", "It was good. Was it? The old cat, the new cat."), ("b", "One."), ("c", "")], "doc_id string, text string")
    tok = tk.annotate_fixture(docs)
    got = {r["doc_id"]: r for r in xp.extended_features(tok, docs, hedges=["good"]).collect()}
    assert set(got) == {"a", "b"}
    words = ex.word_counts(tok)
    for single in (ex.surface(docs, tok), ex.readability(tok), ex.richness(words).drop("entropy"), ex.pos_measures(tok).drop("lexical_density"),
                   ex.global_legomena(words), ex.moving_ttr(tok), ex.segment_ttr(tok), ex.textual_diversity(tok),
                   ex.hypergeometric_diversity(words), ex.tree_measures(tok)):
        for r in single.collect():
            for name, value in r.asDict().items():
                assert got[r["doc_id"]][name] == (pytest.approx(value) if isinstance(value, float) else value), name
    assert got["a"]["n_hedges"] == 1 and got["a"]["n_per_pos"]["PUNCT"] == 4
    few = xp.extended_features(tok, docs, {"lexical_richness": ["ttr"], "surface": ["n_tokens"]})
    assert few.columns == ["doc_id", "n_tokens", "ttr"]


def test_tree_shapes_equal_plain_levels(spark):
    import pyarrow as pa
    rng = random.Random(9)
    batch = []
    for _ in range(200):
        n = rng.randint(1, 20)
        batch.append([rng.choice([i, rng.randrange(n), rng.randrange(n), -1, n + 2]) for i in range(n)])
    got = syntax.shapes(pa.array(batch, pa.list_(pa.int32()))).to_pylist()
    trees = syntax.preorder_trees(pa.array(batch, pa.list_(pa.int32())), pa.array([[f"w{i}" for i in range(len(h))] for h in batch]))
    for heads, shape, tree in zip(batch, got, trees.to_pylist()):
        kids = {}
        for node, up in enumerate(heads):
            if up != node:
                kids.setdefault(up, []).append(node)
        level, depth, width = [n for n, up in enumerate(heads) if up == n], 0, 0
        while level:
            depth, width = depth + 1, max(width, len(level))
            level = [k for n in level for k in kids.get(n, ())]
        assert shape == {"depth": depth, "width": width, "parents": len(kids)}

        def visit(i):
            inner = "".join(visit(k) for k in kids.get(i, ()))
            return f"(w{i}" + (inner if i in kids else ")")

        roots = [i for i, up in enumerate(heads) if up == i or not 0 <= up < len(heads)]
        assert tree == "".join(map(visit, roots)) + ")" * sum(1 for k in kids if 0 <= k < len(heads))
    assert len(syntax.preorder_trees(pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.string())))) == 0


def test_lexicon_measures_annotate_once(spark, tmp_path):
    """The lexicon of a query comes from the stored counts, not from the texts again."""
    from styloweave.plans import document_queries as dq

    spark.createDataFrame([(1, "The houses are old houses."), (None, "An old house."), (2, None)], "doc_id long, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("sentiment", "synsets", "psycholinguistic", "lexicon"):
        df = getattr(dq, name)(spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan
        assert {r["doc_id"] for r in df.collect()} == {1, None}


def test_folders_of_several_files_are_one_part(spark, tmp_path):
    def get():
        return mt.get_or_compute_parts(spark, f"{tmp_path}/out", f"{tmp_path}/in/*", {"a": 1},
                                       lambda new: new.groupBy("part_key", "doc_id").count())

    for k in range(2):
        spark.range(k * 10, k * 10 + 10, numPartitions=3).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/in/{k}")
    first = get()
    assert (first.new, first.kept, first.new_folders, first.kept_folders) == (6, 0, 2, 0)
    spark.range(20, 30, numPartitions=2).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/in/2")
    again = get()
    assert (again.new, again.kept, again.new_folders, again.kept_folders) == (2, 6, 1, 2)
    assert sorted(r["doc_id"] for r in again.rows.collect()) == list(range(30))


def test_no_task_reads_all_documents(spark, tmp_path, monkeypatch):
    """Each folder is written by the tasks that read the documents, not by one for all."""
    from styloweave.plans import source_queries as sq
    many = spark.range(300, numPartitions=6).selectExpr("id AS doc_id", "repeat('a word. ', 50) AS text")
    many.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(sq, "fresh_folder", lambda _: f"{tmp_path}/work")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = sq.stored_by_part(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    assert len(rows) == 300 and {(r["new"], r["kept"]) for r in rows} == {(1, 2)}
    assert all(len([*(tmp_path / "work" / "docs" / str(k)).glob("*.parquet")]) > 1 for k in range(3))


def test_correlation_of_documents_of_which_some_have_no_tokens(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    texts = ["The cat of the house and a dog.", "of of the", "", None, "  ", "and then to the house", "nothing", "a to an of"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {(a, b): r for a, b, r in con.execute(entry.oracle_sql()["k10_correlation"]).fetchall()}
    found = {(r["a"], r["b"]): r["r"] for r in entry.queries()["k10_correlation"](spark, str(tmp_path)).collect()}
    assert found.keys() == want.keys() and sum(r is not None for r in want.values()) > 20
    assert all((found[k] is None) == (r is None) and (r is None or abs(found[k] - r) < 2e-5) for k, r in want.items())
