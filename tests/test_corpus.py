"""Labels, rebuild, stream, splits, models, selection, comparison, storage."""

import collections

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from styloweave.functions import labels as lb
from styloweave.functions import text as tx
from styloweave.operators import compare as cp
from styloweave.operators import corpus_stats as cs
from styloweave.operators import modeling as md
from styloweave.operators import rebuild as rb
from styloweave.operators import sampling as sp
from styloweave.operators import selection as sel
from styloweave.operators import tokens as tk
from styloweave.plans import flows
from styloweave.sources import materialise as mt
from styloweave.sources import readers as rd
from styloweave.sources import writers as wr
from styloweave.streaming import rebuild_stream as rs


def column(spark, values, expr, name="v"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[1] for r in df.select("i", expr(F.col(name))).orderBy("i").collect()]


IDS = ["acad_0001@chunk_2", "acad_0001@chunk_1", "x@gpt-4o-mini-2024", "x@gpt-4o-2024",
       "x@Meta-Llama-3-8B-Instruct", "x@Meta-Llama-3-8B", "plain"]


def test_categories(spark):
    assert column(spark, IDS, lambda c: lb.category_of(lb.model_of(c))) == [
        "human", "human_chunk_1", "gpt-4o-mini", "gpt-4o", "llama-3-8b-instruct", "llama-3-8b-base", "other"]
    assert column(spark, IDS, lambda c: lb.explored_category_of(lb.explored_model_of(c)))[:2] == ["human"] * 2
    assert column(spark, IDS, lb.binary_author)[2:4] == ["gpt", "gpt"]


def test_feature_names(spark):
    names = ["punctuation::", "types:count", "plain"]
    assert column(spark, names, lb.feature_type) == ["punctuation", "types", None]
    assert column(spark, names, lb.feature_value) == [":", "count", None]


def test_spacing(spark):
    assert column(spark, ["Hello , world ( ok ) !", "  a  b  ."], tx.repair_spacing) == [
        "Hello, world (ok)!", "a b."]


def test_word_count(spark):
    assert column(spark, ["", "  ", "one", " a  b\nc "], tx.word_count) == [0, 0, 1, 3]


def token_rows(spark, docs):
    rows = [(d, s, i, w) for d, sents in docs.items() for s, sent in enumerate(sents)
            for i, w in enumerate(sent.split())]
    return spark.createDataFrame(rows, "doc_id string, sentence_id int, token_id int, token string")


CORPUS = {"a@chunk_2": ["Hello , world ( ok ) !", "It ends ."], "b@gpt-4o": ["Well , no ."],
          "c@gpt-4o": ["Yes ."], "d@chunk_1": ["Not kept ."]}


def test_rebuild_ignores_row_order(spark):
    tok = token_rows(spark, CORPUS).orderBy(F.rand(3))
    got = {r["doc_id"]: r["text"] for r in rb.rebuild_documents(tok).collect()}
    assert got["a@chunk_2"] == "Hello, world (ok)! It ends."
    counted = {r[0]: (r[1], r[2]) for r in rb.category_counts(tok, 1).collect()}
    assert counted == {"human": (1, 1), "gpt-4o": (2, 1)}
    kept = rb.rebuild_corpus(tok, limit_per_category=1).collect()
    assert collections.Counter(r["model_category"] for r in kept) == {"human": 1, "gpt-4o": 1}


def test_corpus_is_written_by_category(spark, tmp_path):
    docs = rb.rebuild_corpus(token_rows(spark, CORPUS))
    wr.write_corpus(docs, str(tmp_path / "c"))
    files = {c: p for c, p in rd.default_category_files(str(tmp_path / "c")).items() if c in ("human", "gpt-4o")}
    back = rd.read_category_files(spark, files)
    assert {(r["doc_id"], r["author_id"]) for r in back.collect()} == {
        ("a@chunk_2", "human"), ("b@gpt-4o", "llm"), ("c@gpt-4o", "llm")}
    assert rd.read_category_files(spark, {"gpt-4o": "nowhere"}, []).count() == 0


@pytest.mark.parametrize("stateful", [True, False])
def test_stream_rebuilds_finished_documents(spark, tmp_path, stateful):
    tok = token_rows(spark, CORPUS)
    start = F.lit("2024-01-01").cast("timestamp")
    offset = F.when(F.col("doc_id") < "c", 0).otherwise(7200)
    timed = tok.withColumn("ingested", F.timestamp_add("SECOND", offset + F.col("token_id"), start))
    timed.coalesce(1).write.parquet(str(tmp_path / "in" / "p=1"))
    stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in" / "*"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    if stateful:
        docs = rs.rebuild_stream(stream, "ingested", "5 minutes", "1 minute")
        rs.write_documents(docs, out, state).awaitTermination()
        want = {"a@chunk_2", "b@gpt-4o"}  # the later documents are not finished yet
    else:
        rs.rebuild_batches(stream, out, state).awaitTermination()
        want = set(CORPUS)
    got = {r["doc_id"]: r["text"] for r in spark.read.parquet(out).collect()}
    assert set(got) == want
    assert got["a@chunk_2"] == "Hello, world (ok)! It ends."


@pytest.mark.parametrize("sizes, fraction, held", [
    ({"human": 9615, "llm": 57690}, 0.2, {"human": 1923, "llm": 11538}),
    ({"human": 8290, "gpt": 8290}, 0.4, {"human": 3316, "gpt": 3316}),
    ({"a": 1, "b": 2, "c": 4}, 0.5, {"a": 1, "b": 1, "c": 2}),
])
def test_quotas(spark, sizes, fraction, held):
    df = spark.createDataFrame(list(sizes.items()), "label string, size long")
    got = {r["label"]: r["quota"] for r in sp.held_out_quotas(df, fraction).collect()}
    assert got == held


def labelled(spark, sizes):
    df = None
    for name, n in sizes.items():
        part = spark.range(n).select(F.concat(F.lit(name), F.col("id")).alias("doc_id"),
                                     F.lit(name).alias("label"), F.col("id").alias("arrival"))
        df = part if df is None else df.unionByName(part)
    return df


def test_three_way_sizes_with_a_dominant_class(spark):
    df = labelled(spark, {"human": 9000, "gpt": 580, "x": 3})
    got = collections.Counter((r["label"], r["split"]) for r in sp.three_way_split(df, "label").collect())
    assert sum(got.values()) == 9583
    assert got[("human", "train")] == 5399 and got[("human", "dev")] == 1800
    again = sp.three_way_split(df.repartition(5), "label")
    assert again.exceptAll(sp.three_way_split(df, "label")).count() == 0


def test_samples(spark):
    df = labelled(spark, {"a": 500, "b": 7})
    got = collections.Counter(r["label"] for r in sp.sample_per_class(df, "label", 40).collect())
    assert got == {"a": 40, "b": 7}
    assert sp.sample_rows(df, 33).count() == 33
    assert sp.sample_per_class(df, "label", 0).count() == 0


@pytest.mark.parametrize("n", [1, 3, 250, 499, 500, 900])
def test_first_per_class_is_exact(spark, n):
    df = labelled(spark, {"a": 500, "b": 7}).withColumn("arrival", (F.col("arrival") * 37) % 101)
    got = {(r["label"], r["doc_id"]) for r in sp.first_per_class(df, "label", n, "arrival").collect()}
    rows = [tuple(r) for r in df.select("label", "arrival", "doc_id").collect()]
    want = set()
    for label in "ab":
        want |= {(label, d) for _, d in sorted((a, d) for lab, a, d in rows if lab == label)[:n]}
    assert got == want


def vectors(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        human = i % 2 == 0
        x = rng.normal(1.0 if human else -0.5, 1.0, 3)
        rows.append((f"{i}", "human" if human else "llm", "human" if human else ("gpt-4o", "gpt-4o-mini")[i % 4 // 2],
                     Vectors.dense([float(x[0]), float(x[1] * 50), 3.0])))
    return spark.createDataFrame(rows, ["doc_id", "author_id", "model_category", "features"])


def test_scaling_leaves_constants_alone(spark):
    df = vectors(spark)
    factors = md.scale_factors(df)
    m = np.array([r["features"].toArray() for r in df.collect()])
    assert factors[2] == 1.0
    assert np.allclose(factors[:2], 1 / m[:, :2].std(axis=0))


def test_model_solves_the_penalised_problem(spark):
    df = vectors(spark)
    model = md.train_model(df)
    assert model.classes == ["human", "llm"]
    rows = df.collect()
    x = np.array([r["features"].toArray() for r in rows]) * model.factors
    y = np.array([r["author_id"] == "llm" for r in rows], float)
    w, b = np.array(model.weights), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert max(np.abs(x.T @ (p - y) + w).max(), abs((p - y).sum())) < 1e-6 and model.slope < 1e-6
    coefs = model.coefficients(spark, [("f", "a"), ("f", "b"), ("f", "c")]).collect()
    assert coefs[0]["llm"] == -coefs[0]["human"] and abs(coefs[0]["llm"]) >= abs(coefs[1]["llm"])
    with pytest.raises(ValueError):
        md.train_model(df.withColumn("author_id", F.lit("one")))


def test_model_equals_the_library(spark):
    """Spark ML's own solver, run to a small tolerance, finds the same weights."""
    from pyspark.ml.classification import LogisticRegression
    df = vectors(spark)
    model = md.train_model(df, c=0.7)
    scaled = md.scale(df, model.factors).withColumn("y", (F.col("author_id") == "llm").cast("double"))
    fitted = LogisticRegression(labelCol="y", regParam=1 / (0.7 * 400), standardization=False, tol=1e-13, maxIter=500).fit(scaled)
    assert np.allclose(fitted.coefficients.toArray(), model.weights, atol=1e-5) and np.isclose(fitted.intercept, model.intercept, atol=1e-5)
    sides = {r["doc_id"]: r["prediction"] for r in fitted.transform(scaled).collect()}
    assert all(sides[r["doc_id"]] == (r["predicted"] == "llm") for r in model.predict(df).collect())


def test_models_together_equal_models_alone(spark):
    df = vectors(spark).cache()
    together = flows.fit_pairs(df, ["gpt-4o", "gpt-4o-mini"], keep=["doc_id"])
    for k, name in enumerate(["gpt-4o", "gpt-4o-mini"]):
        own = df.where((F.col("model_category") == name) | (F.col("author_id") == "human"))
        alone = flows.within_corpus(own)
        assert np.allclose(together.models[k].weights, alone.model.weights, atol=1e-6)
        assert (together.accuracy(k, 1), together.accuracy(k, 2)) == (alone.train_accuracy, alone.test_accuracy)
        assert (together.size(k, 1), together.size(k, 2)) == (alone.n_train, alone.n_test) == (240, 60)
    checked = flows.certificate(together).collect()
    assert len(checked) == 2 and all(r["slope"] < 1e-6 and r["counts_agree"] for r in checked)
    together.models[0].weights[0] += 1e-3   # a wrong table is found out
    wrong = {r["llm"]: r for r in flows.certificate(together).collect()}
    assert wrong["gpt-4o"]["slope"] > 1e-4 and wrong["gpt-4o-mini"]["slope"] < 1e-6


def test_sparse_dense_wide_and_empty_vectors(spark):
    from styloweave.operators import newton
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        x = rng.normal(size=300) * (rng.random(300) < 0.1)
        x[7] = 5.0
        v = Vectors.sparse(300, {int(j): float(x[j]) for j in np.flatnonzero(x)}) if i % 3 else Vectors.dense(x.tolist())
        rows.append((str(i), "llm" if x[:20].sum() - 5 > 0 or i % 7 == 0 else "human", Vectors.sparse(300, {}) if i == 5 else v))
    df = spark.createDataFrame(rows, ["doc_id", "author_id", "features"]).repartition(40)   # two levels of sums
    model = md.train_model(df)
    x = np.array([r["features"].toArray() for r in df.collect()])
    assert np.allclose(model.factors, 1 / np.where(x.std(0) > 0, x.std(0), 1))
    y = np.array([r["author_id"] == "llm" for r in df.collect()], float)
    p = 1 / (1 + np.exp(-(x * model.factors @ model.weights + model.intercept)))
    assert np.abs((x * model.factors).T @ (p - y) + model.weights).max() < 1e-6
    assert newton.width_of(df.limit(0)) == 0


def test_flows(spark):
    df = vectors(spark).cache()
    assert flows.train_and_report(df).test_accuracy > 0.7
    pairs = {r["llm"]: r for r in flows.pairwise(df, ["gpt-4o", "gpt-4o-mini"]).collect()}
    assert pairs["gpt-4o"]["n_train"] == 240 and pairs["gpt-4o"]["n_test"] == 60
    assert pairs["gpt-4o"]["Test"].endswith("%")
    assert flows.across_corpora(df, vectors(spark, seed=5)).first()["test_accuracy"] > 0.7


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "a")], "author_id string, predicted string")
    got = {r["class"]: r for r in md.classification_report(df).collect()}
    assert got["b"]["precision"] == 0.0 and got["b"]["f1"] == 0.0 and got["b"]["support"] == 1
    assert got["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert got["macro avg"]["recall"] == 0.5


COEFS = [("types:count", -3.0, 3.0), ("punctuation:.", 1.5, -1.5), ("punctuation::", 0.1, -0.1),
         ("func_words:which", 1.5, -1.5), ("plain", 9.0, -9.0)]


def test_selection(spark):
    coefs = spark.createDataFrame([(*c, i) for i, c in enumerate(COEFS)],
                                  "feature string, human double, gpt double, ord int")
    top = sel.top_features(coefs, 4)
    assert [r["feature"] for r in top.collect()] == ["plain", "types:count", "punctuation:.", "func_words:which"]
    assert {r["type"]: r["items"] for r in sel.by_type(coefs).collect()}["punctuation"] == [".", ":"]
    with pytest.raises(ValueError):
        sel.order_by_magnitude(coefs, "other")
    vocabs, config = sel.selected_vocabs(["punctuation::", "types:count", "plain"])
    assert vocabs == {"punctuation": [":"], "types": ["count"]} and sum(config.values()) == 2


def test_missing_columns_are_reported(spark):
    df = spark.createDataFrame([("d", 1.0, "x")], "doc_id string, `f:a` double, note string")
    got, missing = sel.select_columns(df, ["f:a", "f:b"])
    assert got.columns == ["doc_id", "f:a"] and missing == ["f:b"]
    assert sel.numeric_columns(df).columns == ["doc_id", "f:a"]


def test_comparison(spark):
    a = spark.createDataFrame([("d", "x", 1.0), ("d", "y", 2.0)], "doc_id string, feature string, value double")
    b = spark.createDataFrame([("d", "x", 1.5), ("d", "z", 0.25)], "doc_id string, feature string, value double")
    assert {r["feature"]: r["side"] for r in cp.column_overlap(a, b).collect()} == {"x": "both", "y": "a", "z": "b"}
    assert tuple(cp.difference_summary(a, b).first()) == (2.0, pytest.approx(2.75 / 3), 3)
    assert [r["feature"] for r in cp.most_different(a, b, 2).collect()] == ["y", "x"]


def test_feature_variance_counts_absent_values(spark):
    long = spark.createDataFrame([("a", "f", "x", 0.5), ("b", "f", "x", 0.1)],
                                 "doc_id string, feature string, item string, value double")
    got = cs.feature_variance(long, 4).first()["variance"]
    assert got == pytest.approx(np.var([0.5, 0.1, 0, 0], ddof=1))


def test_config_hash():
    names = """pos_unigrams pos_bigrams dep_labels morph_tags sentences emojis func_words punctuation letters
        transitions unique_transitions tokens num_tokens types sentence_count named_entities suasive_verbs
        stative_verbs""".split()
    config = {n: int(n != "letters") for n in names}
    assert mt.config_hash(config) == "79bca0d00644"
    assert mt.config_hash(config, ["x"]) != mt.config_hash(config)


def test_stored_vectors_are_reused_only_for_the_same_input(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    calls = []

    def get(df):
        def build():
            calls.append(1)
            return df.withColumn("v", F.lit(1.0))
        return mt.get_or_compute(spark, str(tmp_path), "train", {"f": 1}, build,
                                 depends_on=[mt.input_fingerprint(df)], tag="style")
    assert get(docs).count() == 2 and get(docs.repartition(3)).count() == 2
    assert len(calls) == 1
    assert get(docs.limit(1)).count() == 1 and len(calls) == 2
    kept = mt.inventory(spark, str(tmp_path)).collect()
    assert len(kept) == 2 and all(r["bytes"] > 0 for r in kept)
    assert mt.load_vectors(spark, str(tmp_path / "none.parquet")) is None


def test_readers(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "letters.txt").write_text("a\n\n b \na\n")
    assert rd.vocab_lists(rd.read_vocabs(spark, str(tmp_path / "v"))) == {"letters": ["a", "b"]}
    (tmp_path / "t.csv").write_text('id,text\n1,"two\nlines"\n2,x\n')
    assert rd.read_csv_texts(spark, str(tmp_path / "t.csv")).count() == 2
    with pytest.raises(ValueError):
        rd.read_csv_texts(spark, str(tmp_path / "t.csv"), "body")
    (tmp_path / "l.txt").write_text(" a \n\nb\n")
    assert sorted(r["text"] for r in rd.read_text_lines(spark, str(tmp_path / "l.txt"), 5).collect()) == list("aaabb")
    (tmp_path / "d.jsonl").write_text('{"doc_id": "1", "text": "t"}\n')
    assert rd.read_json_lines(spark, str(tmp_path / "d.jsonl")).first()["author_id"] is None


def test_lines_and_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("f", [1, 2])], "a string, b array<int>")
    wr.write_csv(wr.flattened(df), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["b"] == "[1,2]"


def test_null_labels_and_repeated_ids(spark):
    rows = [(i % 80, "a" if i % 4 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, label string, n int")
    counts = {(r["label"], r["split"]): r["count"] for r in
              sp.stratified_split(df, "label", 0.2).groupBy("label", "split").count().collect()}
    assert counts == {("a", "train"): 120, ("a", "test"): 30, (None, "train"): 40, (None, "test"): 10}
    got = {r["label"]: r["count"] for r in sp.sample_per_class(df, "label", 25).groupBy("label").count().collect()}
    assert got == {"a": 25, None: 25}
    same = spark.createDataFrame([(1, "a")] * 10, "doc_id int, label string")
    with pytest.raises(ValueError):
        sp.sample_per_class(same, "label", 4)


def test_first_per_class_with_one_arrival(spark):
    rows = [(i, "a" if i % 3 else None, 7 if i < 90 else 9) for i in range(120)] + [(999, "a", None)]
    df = spark.createDataFrame(rows, "doc_id int, label string, arrival int")
    for n in (10, 60, 65, 500):
        got = sp.first_per_class(df, "label", n, "arrival").collect()
        for label, tied, late in (("a", 60, 20), (None, 30, 10)):
            own = [r for r in got if r["label"] == label]
            assert len(own) == min(n, tied + late) and sum(r["arrival"] == 7 for r in own) == min(n, tied)
            assert len({r["doc_id"] for r in own}) == len(own)


def test_cross_table_keeps_the_rest(spark):
    df = spark.createDataFrame([("x", "a"), ("y", "z"), ("y", None)], "r string, c string")
    got = {r["r"]: (r["a"], r["b"], r["other"]) for r in cs.cross_table(df, "r", "c", ["a", "b"]).collect()}
    assert got == {"x": (1, 0, 0), "y": (0, 0, 2)}


def test_text_lines_in_place(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two \nthree\n")
    for n in (2, 3, 8, 10):
        got = sorted(r["text"] for r in rd.read_text_lines(spark, str(tmp_path), n).collect())
        assert len(got) == n and all(n // 3 <= got.count(x) <= -(-n // 3) for x in ("one", "two", "three"))


def test_overlap_by_prefix(spark):
    a = spark.createDataFrame([("p:x",), ("p:y",)], "feature string")
    b = spark.createDataFrame([("p:y",), ("q:z",)], "feature string")
    assert {tuple(r) for r in cp.overlap_by_prefix(a, b).collect()} == {("p", 1, 0, 1), ("q", 0, 1, 0)}


def test_late_tokens_and_long_pauses_are_reconciled(spark, tmp_path):
    tok = token_rows(spark, CORPUS)
    start = F.lit("2024-01-01").cast("timestamp")
    first = F.col("doc_id") == "a@chunk_2"
    # the first document pauses for two hours after its second token
    offset = F.when(first & (F.col("token_id") > 1), 7200).when(first, 0).otherwise(60)
    timed = tok.withColumn("ingested", F.timestamp_add("SECOND", offset + F.col("token_id"), start))
    end = timed.limit(1).withColumn("doc_id", F.lit("end")).withColumn("ingested", F.timestamp_add("DAY", F.lit(1), start))
    late = timed.where(first).limit(1).withColumn("token", F.lit("late")).withColumn("token_id", F.lit(99)) \
        .withColumn("sentence_id", F.lit(9))
    for n, part in enumerate((timed, end, late)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))
        stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in" / "*"))
        docs = rs.rebuild_stream(stream, "ingested", "5 minutes", "1 minute")
        rs.write_documents(docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "in")).select(timed.columns).where("doc_id <> 'end'")
    finished = spark.read.parquet(str(tmp_path / "out")).where("doc_id <> 'end'")
    assert finished.where(first).count() == 2
    got = {r["doc_id"]: r["text"] for r in rs.reconciled(finished, table).collect()}
    assert set(got) == set(CORPUS) and got == {r["doc_id"]: r["text"] for r in rb.rebuild_documents(table).collect()}
    assert got["a@chunk_2"].endswith("late")


def test_lines_are_replicated_at_every_size(spark, tmp_path):
    from styloweave.plans import source_queries

    text = "\n".join(f"line {i}" for i in range(70_000))
    spark.createDataFrame([(k, text.replace("line", f"line {k}")) for k in range(3)], "doc_id long, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = source_queries.replicated_lines(spark, str(tmp_path))
    assert got.count() == 210_000 and got.where("NOT in_share").count() == 0


def test_profiles_as_vectors_are_compressed_as_by_spark(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector
    from styloweave.operators import style
    item = "struct<idx:int,feature:string,item:string,n:bigint,denom:bigint,value:double>"
    full = [(n, "f", str(n), n, 1, float(n)) for n in range(9)]
    rows = [("a", "x", full[2:4]), (None, None, []), ("b", "y", full), ("c", "z", full[:1]), ("d", "z", full[:7])]
    profiles = spark.createDataFrame(rows, f"doc_id string, author_id string, items array<{item}>").coalesce(1)
    dense = profiles.select("doc_id", "author_id", array_to_vector(style.dense_array(10)).alias("dense"))
    expected = VectorAssembler(inputCols=["dense"], outputCol="features").transform(dense).drop("dense")
    found = md.model_vectors(profiles, 10, ["author_id"])
    assert found.dtypes == expected.dtypes
    assert list(map(repr, found.collect())) == list(map(repr, expected.collect()))
    assert not found.limit(0).collect()


def test_columns_without_values_in_training_have_no_weight(spark):
    """Only the penalty sees them, so steps leave them out; test rows may have them."""
    from styloweave.operators import newton
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        x = rng.normal(size=40) * (np.arange(40) % 4 == 0)
        train = i % 5 > 0
        x[7] = 0.0 if train else 3.0
        rows.append((float(x[0] + 0.3 * rng.normal() > 0), 1 if train else 2, Vectors.sparse(40, {int(j): float(x[j]) for j in np.flatnonzero(x)})))
    df = spark.createDataFrame(rows, ["y", "part", "features"]).repartition(5)
    packed = newton.packed(df, F.col("y"), F.array("part"))
    fit, = newton.fit_many(packed, 1, 40)
    x = np.array([r["features"].toArray() for r in df.where("part = 1").collect()])
    y = np.array([r["y"] for r in df.where("part = 1").collect()])
    p = 1 / (1 + np.exp(-(x * fit.factors @ fit.weights + fit.intercept)))
    assert np.abs((x * fit.factors).T @ (p - y) + fit.weights).max() < 1e-6 and fit.n == 160
    assert np.flatnonzero(fit.weights).tolist() == list(range(0, 40, 4)) and fit.factors[7] == 1.0
    counts = newton.confusions(packed, [fit], 40).groupBy("part").sum("n").collect()
    assert sorted(map(tuple, counts)) == [(1, 160), (2, 40)]
    some = newton.summed_bands(newton.blocked(packed.coalesce(1)), lambda x, y, parts: [(0, x.sum(0, keepdims=True))], 40, np.array([0, 7]))
    whole = sum(r["features"].toArray() for r in df.collect())
    assert np.allclose(np.frombuffer(some.first()["payload"]), [whole[0], whole[7], 200])
