"""Style features on hand-made tokens with values computed by hand."""

import pytest
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.operators import style
from styloweave.operators import tokens as tk
from styloweave.plans.style_queries import only


def words(text):
    return text.split()


def values(df):
    return {(r["doc_id"], f"{r['feature']}:{r['item']}"): (r["n"], r["denom"], r["value"])
            for r in df.collect()}


def vec(tok, *features, **how):
    return values(style.sparse_long(style.vectorize(tok, config=only(*features), **how)))


def test_vector_width():
    assert len(style.vector_columns()) == 888
    assert len(style.vector_columns(style.default_config(letters=0))) == 825


def test_bigrams_count_boundaries_in_the_denominator_only(tokens):
    pos = ["DET", "NOUN", "PUNCT"]
    sent = lambda ws: [{"token": w, "pos": p} for w, p in zip(ws, pos)]
    tok = tokens({"d": [sent("A b .".split()), sent("C d !".split())]})
    got = vec(tok, "pos_bigrams")
    assert got[("d", "pos_bigrams:DET NOUN")] == (2, 9, 2 / 9)
    assert got[("d", "pos_bigrams:NOUN PUNCT")] == (2, 9, 2 / 9)
    assert ("d", "pos_bigrams:PUNCT DET") not in got
    simple = vec(tok, "pos_bigrams", profile="simple")
    assert simple[("d", "pos_bigrams:PUNCT DET")] == (1, 5, 0.2)


def test_empty_document_is_all_zero(spark, tokens):
    tok = tokens({"full": [words("the end .")]})
    docs = spark.createDataFrame([("full", "the end ."), ("empty", "")], "doc_id string, text string")
    config = style.default_config(sentences=0)
    profiles = style.vectorize(tok, docs=docs, config=config)
    columns = style.vector_columns(config)
    wide = style.wide(profiles, columns, ["func_words:the", "tokens:count", "pos_bigrams:ADJ ADP"])
    rows = {r["doc_id"]: r.asDict() for r in wide.collect()}
    assert set(rows["empty"].values()) == {"empty", 0.0}
    assert rows["full"]["func_words:the"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("sentences, count, unique, quote_ok", [
    ([["However , it works ."]], 1, 1, False),
    ([["\" However , it works ."]], 0, 0, False),
    ([["\" However , it works ."]], 1, 1, True),
    ([["And however , it works ."]], 1, 1, False),
    ([["However ,"]], 0, 0, False),
    ([["However , a .", "However , b ."]], 2, 1, False),
    ([["But in fact , no ."]], 1, 1, False),
    ([["In spite of all this , we go ."]], 1, 1, False),
    ([["In fact it , was ."]], 0, 0, False),
])
def test_transitions(tokens, sentences, count, unique, quote_ok):
    tok = tokens({"d": [words(s) for s in sentences[0]]})
    got = vec(tok, "transitions", "unique_transitions", quote_ok=quote_ok)
    assert got[("d", "transitions:count")][0] == count
    assert got[("d", "unique_transitions:count")][0] == unique


def test_first_listed_transition_wins(tokens):
    tok = tokens({"d": [words("And yet , it moves .")]})
    got = style.transition_matches(tok, ["yet", "and yet"]).collect()
    assert [r["transition"] for r in got] == ["yet"]
    got = style.transition_matches(tok, ["and yet", "yet"]).collect()
    assert [r["transition"] for r in got] == ["and yet"]


def test_function_words_keep_case(tokens):
    tok = tokens({"d": [words("The the")]})
    assert vec(tok, "func_words")[("d", "func_words:the")] == (1, 2, 0.5)
    assert vec(tok, "func_words", profile="simple")[("d", "func_words:the")] == (2, 2, 1.0)


def test_punctuation_is_by_character_or_by_token(tokens):
    tok = tokens({"d": [[{"token": "...", "pos": "PUNCT"}, {"token": "o'clock-x"}]]})
    got = vec(tok, "punctuation")
    assert got[("d", "punctuation:.")][:2] == (3, 2)
    assert got[("d", "punctuation:'")][0] == 1 and got[("d", "punctuation:-")][0] == 1
    assert vec(tok, "punctuation", profile="simple") == {}


def test_letter_denominators(tokens):
    tok = tokens({"d": [["aß"]]})
    assert vec(tok, "letters")[("d", "letters:a")] == (1, 1, 1.0)
    assert vec(tok, "letters", letters="single")[("d", "letters:a")] == (1, 2, 0.5)


def test_morphology_skips_empty(tokens):
    tok = tokens({"d": [[{"token": "was", "morph": "Tense=Past|Odd=Yes"}, {"token": "x"}]]})
    assert vec(tok, "morph_tags") == {("d", "morph_tags:Tense=Past"): (1, 2, 0.5)}


def test_emoji_sequences(spark):
    docs = spark.createDataFrame([("d", "hi 👍🏽 👍 ❤️ 👩‍👧 😀😀 🇫🇷 1 #")], "doc_id string, text string")
    got = vec(tk.tokenize(docs), "emojis", docs=docs)
    assert got[("d", "emojis:👍")][0] == 1
    assert got[("d", "emojis:😀")][0] == 2
    assert got[("d", "emojis:❤️")][0] == 1
    assert ("d", "emojis:👩") not in got
    simple = vec(tk.tokenize(docs), "emojis", docs=docs, profile="simple")
    assert simple[("d", "emojis:😀")][1] == 7


def test_verbs_and_entities_need_a_vocabulary(tokens):
    tok = tokens({"d": [[{"token": "insisted", "lemma": "insist"}, {"token": "Ada", "ent_type": "PERSON"},
                         {"token": "Lee", "ent_type": "PERSON"}]]})
    assert vec(tok, "suasive_verbs", "named_entities") == {}
    vocabs = style.default_vocabs() | {"suasive_verbs": ["insist"], "named_entities": ["PERSON"]}
    got = vec(tok, "suasive_verbs", "named_entities", vocabs=vocabs)
    assert got == {("d", "suasive_verbs:insist"): (1, 1, 1.0),
                   ("d", "named_entities:PERSON"): (1, 1, 1.0)}


def test_unigram_shares_sum_to_one_and_dense_equals_sparse(tokens):
    tok = tokens({"d": [[{"token": "a", "pos": "DET"}, {"token": "b", "pos": "NOUN"}, {"token": "c", "pos": "X"}]],
                  "e": [[{"token": "z", "pos": "ADJ"}]]})
    config = only("pos_unigrams")
    profiles = style.vectorize(tok, config=config)
    total = style.sparse_long(profiles).groupBy("doc_id").agg(F.sum("value").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in total)
    columns = style.vector_columns(config)
    dense = {r["doc_id"]: r["v"] for r in profiles.select(
        "doc_id", style.dense_array(len(columns)).alias("v")).collect()}
    assert dense["e"] == [1.0] + [0.0] * 17
    assert [round(x, 6) for x in dense["d"]] == [
        round({"DET": 1, "NOUN": 1, "X": 1}.get(p, 0) / 3, 6) for p in fv.POS_TAGS]


def test_user_feature(spark, tokens):
    tok = tokens({"d": [words("one two three")]})
    extra = tok.where(F.length("token") > 3).groupBy("doc_id").agg(F.count("*").alias("n")) \
        .select("doc_id", F.lit("long").alias("feature"), F.lit("yes").alias("item"), "n")
    vocabs = style.default_vocabs() | {"long": ["yes"]}
    counts = style.feature_counts(tok, config=only("tokens"), vocabs=vocabs, extra=[extra])
    assert {(r["feature"], r["item"]): r["n"] for r in counts.collect()}[("long", "yes")] == 1


def test_token_rows_in_any_order_give_the_same_vectors(spark, tokens):
    tok = tokens({"d": [words("However , the end ."), words("It was .")]})
    config = style.default_config()
    a = style.sparse_long(style.vectorize(tok, config=config))
    b = style.sparse_long(style.vectorize(tok.orderBy(F.rand(1)), config=config))
    assert values(a) == values(b)


def test_bucketed_table_needs_no_shuffle(spark, tokens):
    tok = tokens({str(i): [words("the end of it .")] for i in range(20)})
    spark.sql("DROP TABLE IF EXISTS bucketed_tokens")
    tk.save_bucketed(tok, "bucketed_tokens", 4)
    try:
        stored = spark.table("bucketed_tokens")
        df = style.sparse_long(style.vectorize(stored, config=only("func_words", "types")))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan, plan
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_tokens")


def test_emoji_sequences_without_texts(spark):
    docs = spark.createDataFrame([("d", "ok 👍🏽 👩‍👧 fine 👍 👍")], "doc_id string, text string")
    config = {f: 0 for f in style.fv.STYLE_FEATURES} | {"emojis": 1}
    tok = tk.tokenize(docs)
    with_docs, without = (style.sparse_long(style.vectorize(tok, docs=d, config=config)).where("feature = 'emojis'")
                          .select("item", "n").collect() for d in (docs, None))
    assert sorted(map(tuple, with_docs)) == sorted(map(tuple, without)) == [("👍", 2)]
