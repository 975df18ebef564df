"""Lexicon measures: join a user's word list and average it per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.session import broadcast_if_small


def _lemma_counts(tok: DataFrame, on: str) -> DataFrame:
    """Lemmas (or other keys) per document: the join meets each once, with its count."""
    return tok.groupBy("doc_id", F.lower(on).alias("key")).agg(F.count("*").alias("n"))


def lexicon_features(tok: DataFrame, lexicon: DataFrame, measure: str, *, low: float,
                     high: float, max_sd: float | None = None, on: str = "lemma") -> DataFrame:
    """`avg_<measure>`, `n_low_<measure>`, `n_high_<measure>` per document.

    `lexicon` has `key, value` and, for `avg_sd_` and `n_controversial_`, `sd`. Documents
    without a listed word get null averages and zero counts. The lexicon is broadcast only
    after a check of its size.
    """
    columns = ["key", "value"] + (["sd"] if max_sd is not None else [])
    counted = _lemma_counts(tok, on).join(
        broadcast_if_small(lexicon.select(*columns)), "key", "left")
    known = F.col("value").isNotNull()
    n, value = F.col("n"), F.col("value")

    def total(when):
        return F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")

    aggs = [(F.sum(n * value) / F.sum(F.when(known, n))).alias(f"avg_{measure}"),
            total(value < low).alias(f"n_low_{measure}"),
            total(value > high).alias(f"n_high_{measure}")]
    if max_sd is not None:
        aggs += [(F.sum(n * F.col("sd")) / F.sum(F.when(F.col("sd").isNotNull(), n)))
                 .alias(f"avg_sd_{measure}"),
                 total(F.col("sd") > max_sd).alias(f"n_controversial_{measure}")]
    return counted.groupBy("doc_id").agg(*aggs)


def lexicon_measures(tok: DataFrame, lexicon: DataFrame, measures: dict[str, tuple], on: str = "lemma") -> DataFrame:
    """Several measures by one join: for each name the columns of `lexicon_features`.

    `measures` maps a name to `(low, high)` or `(low, high, max_sd)`; `lexicon` has `key`, a column of each
    name and, for the latter, `sd_<name>`. A word may lack some measures. Counts are named without
    a leading `emotion_`, as in `n_low_intensity` beside `avg_emotion_intensity`.
    """
    return measures_of(_lemma_counts(tok, on), lexicon, measures)


def lexicon_columns(measures: dict[str, tuple]) -> list[str]:
    """Names of the columns that `lexicon_measures` gives."""
    out = []
    for name, limits in measures.items():
        short = name.removeprefix("emotion_")
        out += [f"avg_{name}", f"n_low_{short}", f"n_high_{short}"]
        out += [f"avg_sd_{name}", f"n_controversial_{short}"] if len(limits) > 2 else []
    return out


def measures_of(counts: DataFrame, lexicon: DataFrame, measures: dict[str, tuple]) -> DataFrame:
    """`lexicon_measures` of counts `doc_id, key, n`."""
    columns = [c for name, limits in measures.items() for c in [name, f"sd_{name}"][:1 + (len(limits) > 2)]]
    counted = counts.join(broadcast_if_small(lexicon.select("key", *columns)), "key", "left")
    n = F.col("n")

    def total(when):
        return F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")

    aggs = []
    for name, (low, high, *max_sd) in measures.items():
        value, short = F.col(name), name.removeprefix("emotion_")
        aggs += [(F.sum(n * value) / F.sum(F.when(value.isNotNull(), n))).alias(f"avg_{name}"),
                 total(value < low).alias(f"n_low_{short}"), total(value > high).alias(f"n_high_{short}")]
        if max_sd:
            sd = F.col(f"sd_{name}")
            aggs += [(F.sum(n * sd) / F.sum(F.when(sd.isNotNull(), n))).alias(f"avg_sd_{name}"),
                     total(sd > max_sd[0]).alias(f"n_controversial_{short}")]
    return counted.groupBy("doc_id").agg(*aggs)


def sentiment(tok: DataFrame, lexicon: DataFrame, on: str = "lemma") -> DataFrame:
    """Polarity lexicon: mean polarity per token, and negative and positive words."""
    return sentiment_of(_lemma_counts(tok, on), lexicon)


def sentiment_of(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """`sentiment` of counts `doc_id, key, n`."""
    counted = counts.join(broadcast_if_small(lexicon.select("key", "value")), "key", "left")
    n, value = F.col("n"), F.coalesce("value", F.lit(0.0))
    return counted.groupBy("doc_id").agg(
        (F.sum(n * value) / F.sum(n)).alias("sentiment_score"),
        F.sum(F.when(value < 0, n).otherwise(0)).alias("n_negative_sentiment"),
        F.sum(F.when(value > 0, n).otherwise(0)).alias("n_positive_sentiment"))


def listed_words(tok: DataFrame, words: list[str], name: str, on: str = "token") -> DataFrame:
    """Tokens per document that are in a word list, such as hedges."""
    return tok.groupBy("doc_id").agg(
        F.count_if(F.lower(on).isin([w.lower() for w in words])).alias(name))


def synset_counts(tok: DataFrame, lexicon: DataFrame, low: float, high: float,
                  pos: list[str] = ()) -> DataFrame:
    """Words with few and many senses, all and per part of speech.

    `lexicon` has `key, value` with the number of senses of a lemma.
    """
    return synsets_of(tok.groupBy("doc_id", F.lower("lemma").alias("key"), "pos").agg(F.count("*").alias("n")),
                      lexicon, low, high, pos)


def synsets_of(counts: DataFrame, lexicon: DataFrame, low: float, high: float, pos: list[str] = ()) -> DataFrame:
    """`synset_counts` of counts `doc_id, key, pos, n`."""
    counted = counts.join(broadcast_if_small(lexicon.select("key", "value")), "key", "left")

    def total(when):
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")

    few, many = F.col("value") < low, F.col("value") > high
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    aggs = [(F.sum(F.col("n") * F.col("value")) / F.sum(known)).alias("avg_num_synsets"),
            total(few).alias("n_low_synsets"), total(many).alias("n_high_synsets")]
    for p in pos:
        aggs += [total(few & (F.col("pos") == p)).alias(f"n_low_synsets_{p.lower()}"),
                 total(many & (F.col("pos") == p)).alias(f"n_high_synsets_{p.lower()}")]
    return counted.groupBy("doc_id").agg(*aggs)
