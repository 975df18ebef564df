"""Counters, extended measures, annotations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from styloweave.operators import counters as ct
from styloweave.operators import extended as ex
from styloweave.operators import lexicon as lx
from styloweave.operators import tokens as tk


def t(token, **f):
    return {"token": token, **f}


def test_stative_verbs_with_object_and_person(tokens):
    weigh = dict(lemma="weigh", pos="VERB")
    tok = tokens({
        "no": [[t("He", tag="PRP", dep="nsubj", head=1), t("weighed", head=1, dep="ROOT", **weigh),
                t("bananas", dep="dobj", head=1)]],
        "yes": [[t("bananas", tag="NNS", dep="nsubj", head=1), t("weigh", head=1, dep="ROOT", **weigh)]]})
    plain, ambiguous = ct.split_stative(["know", "weigh (amb)", ""])
    got = ct.document_counters(tok, ["stative_verbs", "avg_verb_chunk_length"], stative=plain,
                               ambiguous=ambiguous)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows["no"]["stative_verbs"] == 0 and rows["yes"]["stative_verbs"] == 1
    assert rows["no"]["avg_verb_chunk_length"] == 2.0


def test_placeholder_people_and_missing_names(spark, tokens):
    tok = tokens({"d": [["PERSON", t("Rome", ent_type="GPE"), "."]]})
    docs = spark.createDataFrame([("d",), ("none",)], "doc_id string")
    got = ct.document_counters(tok, ["named_entities", "NEs_person", "NEs_without_date", "bogus"], docs=docs)
    rows = {r["doc_id"]: r.asDict() for r in got.collect()}
    assert rows["d"] == {"doc_id": "d", "named_entities": 2, "NEs_person": 1, "NEs_without_date": 2}
    assert set(rows["none"].values()) == {"none", 0}


def test_all_58_counters(tokens):
    tok = tokens({"d": [[t("It", tag="PRP", pos="PRON"), t("is", lemma="be", head=1, pos="AUX"),
                         t("good", dep="acomp", head=1)]]})
    assert len(ct.ALL) == 58
    row = ct.document_counters(tok, normalize=True).first().asDict()
    assert set(row) == {"doc_id", *ct.ALL}
    assert row["tokens"] == 1.0 and row["copula_verbs"] == pytest.approx(1 / 3)
    assert row["morph_tags"] == {"": 3} and row["pos_bigrams"] == {"PRON_AUX": 1, "AUX_NOUN": 1}


def test_unknown_punctuation_kind(spark):
    with pytest.raises(ValueError):
        ct.punctuation_count("dashes")


def test_entities_join_neighbours(tokens):
    tok = tokens({"d": [[t("New", ent_type="GPE"), t("York", ent_type="GPE"), "and",
                         t("Ada", ent_type="PERSON")]]})
    spans = {(r["start"], r["end"], r["label"]) for r in tk.entity_spans(tok).collect()}
    assert spans == {(0, 2, "GPE"), (3, 4, "PERSON")}


def test_heads_are_checked(tokens):
    good = tokens({"d": [[t("a", head=0), t("b", head=0)]]})
    assert tk.invalid_heads(good).count() == 0
    bad = tokens({"d": [[t("a", head=1), t("b", head=7)]]})
    assert {r["problem"] for r in tk.invalid_heads(bad).collect()} == {"head outside sentence", "not one root"}


def test_annotation_columns_are_required(spark):
    with pytest.raises(ValueError, match="lemma"):
        tk.from_annotations(spark.createDataFrame([("d", 0, 0, "x")],
                            "doc_id string, sentence_id int, token_id int, token string"))


def test_positions_over_many_blocks(spark):
    rows = [("d", s, i, "w", "w", "X", "X", 0, "dep") for s in range(50) for i in range(s % 4 + 1)]
    df = spark.createDataFrame(rows, "doc_id string, sentence_id int, token_id int, token string, "
                                     "lemma string, pos string, tag string, head_token_id int, dep string")
    got = tk._document_positions(df, block=8).orderBy("sentence_id", "token_id").collect()
    assert [r["token_id"] for r in got] == list(range(len(rows)))


WORDS = ["a", "b", "c", "d", "e", "f", "g"]


def random_docs(spark, seed, sizes):
    rng = random.Random(seed)
    docs = {f"d{i}": [rng.choice(WORDS) for _ in range(n)] for i, n in enumerate(sizes)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id string, text string")
    return docs, tk.tokenize(df), df


def test_moving_ttr_equals_brute_force_across_blocks(spark):
    docs, tok, _ = random_docs(spark, 1, [1, 5, 12, 60, 200])
    got = {r["doc_id"]: r["mattr"] for r in ex.moving_ttr(tok, window=7, block=16).collect()}
    for name, ws in docs.items():
        w = min(7, len(ws))
        ratios = [len(set(ws[i:i + w])) / w for i in range(len(ws) - w + 1)]
        assert got[name] == pytest.approx(sum(ratios) / len(ratios))


def test_hdd_and_mtld_equal_brute_force(spark):
    docs, tok, df = random_docs(spark, 2, [10, 42, 120])
    hdd = {r["doc_id"]: r["hdd"] for r in ex.hypergeometric_diversity(ex.word_counts(tok)).collect()}
    mtld = {r["doc_id"]: r["mtld"] for r in ex.textual_diversity(tok).collect()}

    def factors(ws):
        n, start = 0.0, 0
        for i in range(len(ws)):
            seg = ws[start:i + 1]
            if len(set(seg)) / len(seg) <= 0.72:
                n, start = n + 1, i + 1
        if rest := ws[start:]:
            n += (1 - len(set(rest)) / len(rest)) / 0.28
        return n

    for name, ws in docs.items():
        if len(ws) < 42:
            assert hdd[name] is None
        else:
            N = len(ws)
            want = sum(1 - math.comb(N - ws.count(x), 42) / math.comb(N, 42) for x in set(ws)) / 42
            assert hdd[name] == pytest.approx(want)
        runs = [len(ws) / f for f in (factors(ws), factors(ws[::-1])) if f > 0]
        assert mtld[name] == pytest.approx(sum(runs) / len(runs))


def test_global_legomena(spark):
    df = spark.createDataFrame([("x", "one two two shared"), ("y", "shared three")], "doc_id string, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in ex.global_legomena(ex.word_counts(tk.tokenize(df))).collect()}
    assert got == {"x": (1, 2), "y": (1, 1)}


def test_lexicon_beyond_the_broadcast_bound(spark, tokens, monkeypatch):
    tok = tokens({"d": [["good", "bad", "bad", "table"]]})
    lexicon = spark.createDataFrame([("good", 8.0, 1.0), ("bad", 2.0, 3.0)], "key string, value double, sd double")
    want = lx.lexicon_features(tok, lexicon, "valence", low=4, high=6, max_sd=2).first().asDict()
    assert want == {"doc_id": "d", "avg_valence": 4.0, "n_low_valence": 2, "n_high_valence": 1,
                    "avg_sd_valence": pytest.approx(7 / 3), "n_controversial_valence": 2}
    monkeypatch.setattr(lx, "broadcast_if_small", lambda df: df)
    assert lx.lexicon_features(tok, lexicon, "valence", low=4, high=6, max_sd=2).first().asDict() == want


def test_compressibility_and_readability(spark):
    df = spark.createDataFrame([("d", "aaaa " * 100), ("e", "")], "doc_id string, text string")
    got = {r["doc_id"]: r["compressibility"] for r in ex.compressibility(df).collect()}
    assert got["d"] < 0.1 and got["e"] is None
    row = ex.readability(tk.tokenize(df)).first()
    assert row["n_syllables"] == 100 and row["rix"] == 0.0


def test_tree_measures(tokens):
    tok = tokens({"d": [[t("r", head=0), t("a", head=0), t("b", head=0), t("c", head=1)], [t("x", head=0)]]})
    assert tuple(ex.tree_measures(tok).first())[1:] == (2, 3, 1.5)
