"""Extended measures: surface, richness, complexity, readability, trees, entities.

Formulas are the published ones; a measure is null where its formula is undefined.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from styloweave.functions import fixed_values as fv
from styloweave.functions import text as tx
from styloweave.operators import style, syntax

IS_WORD = r"[a-zA-Z0-9\p{L}\p{N}]"


# --------------------------------------------------------------------------- simple counts
def surface(docs: DataFrame, tok: DataFrame, long_word: int = 6) -> DataFrame:
    """Lengths, counts and distinct words per document.

    The raw length is read from the document and joined; everything else comes from one pass over the
    tokens, whose batches count words and lemmas before they are shuffled.
    """
    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("feature") == kind, value)

    n, length = F.col("n"), F.length("item")
    counted = style.counted_by_batch(tok, [
        ("t", F.coalesce("token", F.lit(style.UNLISTED))), ("l", F.coalesce(F.lower("lemma"), F.lit(style.UNLISTED))),
        ("s", F.when(F.col("sent_pos") == 0, "0"))])
    words = counted.groupBy("doc_id", "feature", F.lower("item").alias("w")).agg(
        F.sum("n").alias("n"), F.sum(n * length).alias("characters"),
        F.sum(F.when(length > long_word, n).otherwise(0)).alias("long"))
    found = words.groupBy("doc_id").agg(
        F.sum(of("t", n)).alias("n_tokens"), F.coalesce(F.sum(of("s", n)), F.lit(0)).cast("long").alias("n_sentences"),
        F.sum(of("t", F.col("characters"))).alias("n_characters"), F.sum(of("t", F.col("long"))).alias("n_long_words"),
        F.count(of("t", F.lit(1))).alias("n_types"), F.count(of("l", F.lit(1))).alias("n_lemmas"))
    raw = docs.select("doc_id", tx.text_length(F.col("text")).alias("raw_sequence_length"))
    return (raw.join(found, "doc_id").select(
        "doc_id", "raw_sequence_length", "n_tokens", "n_sentences",
        (F.col("n_tokens") / F.col("n_sentences")).alias("n_tokens_per_sentence"),
        "n_characters", (F.col("n_characters") / F.col("n_tokens")).alias("avg_word_length"),
        "n_types", "n_long_words", "n_lemmas"))


def pos_measures(tok: DataFrame) -> DataFrame:
    """Lexical tokens, their share (lexical density) and the variety of classes."""
    by_pos = tok.groupBy("doc_id", "pos").agg(F.count("*").alias("n"))
    lexical = F.sum(F.when(F.col("pos").isin(fv.LEXICAL_POS), F.col("n")).otherwise(0))
    return by_pos.groupBy("doc_id").agg(
        lexical.alias("n_lexical_tokens"), (F.count("*") / F.sum("n")).alias("pos_variability"),
        (lexical / F.sum("n")).alias("lexical_density"))


def counts_per(tok: DataFrame, what: str) -> DataFrame:
    """`doc_id, key, n` per `pos`, `morph`, `dep` or `entity`."""
    if what == "morph":
        rows = tok.select("doc_id", F.explode(F.filter(
            F.split(F.coalesce("morph", F.lit("")), r"\|"), lambda m: m != "")).alias("key"))
    elif what == "entity":
        rows = tok.where("ent_start").select("doc_id", F.col("ent_type").alias("key"))
    else:
        rows = tok.select("doc_id", F.col(what).alias("key"))
    return rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"))


def tree_measures(tok: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Deepest path and widest level of any sentence, and children per inner node.

    `shapes` are those of the sentences (`syntax.ordered_shapes`), if known.
    """
    if shapes is None:
        shapes = syntax.sentence_rows(tok).select("doc_id", F.size("heads").alias("n"),
                                                  syntax.tree_shape("heads").alias("t"))
    return shapes.groupBy("doc_id").agg(
        F.max("t.width").cast("long").alias("tree_width"),
        F.max("t.depth").cast("long").alias("tree_depth"),
        F.try_divide(F.sum(F.col("n") - 1), F.sum("t.parents")).alias("tree_branching"))


def span_counts(spans: DataFrame, name: str) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.count("*").alias(name))


# --------------------------------------------------------------------------- richness
def word_counts(tok: DataFrame, on: str = "token") -> DataFrame:
    """`doc_id, word, n`: the frequency table that all richness measures read."""
    return tok.groupBy("doc_id", F.lower(on).alias("word")).agg(F.count("*").alias("n"))


def _guarded(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def richness(words: DataFrame, by: list[str] = ("doc_id",)) -> DataFrame:
    """Type-token ratios and frequency-spectrum measures from a word frequency table."""
    c = F.col("n").cast("double")
    spectrum = words.groupBy(*by).agg(
        F.sum("n").alias("N"), F.count("*").alias("V"),
        F.count_if(F.col("n") == 1).alias("V1"), F.count_if(F.col("n") == 2).alias("V2"),
        F.sum(F.col("n") * F.col("n")).alias("S2"), F.sum(c * F.log2(c)).alias("nlogn"))
    N, V, S2 = (F.col(x).cast("double") for x in ("N", "V", "S2"))
    ln_n, ln_v = F.log(N), F.log(V)
    v_term = S2 / (N * N) - 1 / V
    return spectrum.select(
        *by, F.col("N").alias("n_tokens"), F.col("V").alias("n_types"),
        (V / N).alias("ttr"), (V / F.sqrt(N)).alias("rttr"), (V / F.sqrt(2 * N)).alias("cttr"),
        (V / F.sqrt(N)).alias("giroud_index"),
        _guarded(N > 1, ln_v / ln_n).alias("herdan_c"),
        _guarded((V > 1) & (ln_n > 0) & (F.log(ln_n) != 0), F.log(ln_v) / F.log(ln_n))
        .alias("summer_index"),
        _guarded(V < N, ln_n * ln_n / (ln_n - ln_v)).alias("dugast_u"),
        _guarded(N > 1, (ln_n - ln_v) / (ln_n * ln_n)).alias("maas_index"),
        F.col("V1").alias("n_hapax_legomena"), F.col("V2").alias("n_hapax_dislegomena"),
        (F.col("V2") / V).alias("sichel_s"),
        (F.lit(1e4) * (S2 - N) / (N * N)).alias("yule_k"),
        _guarded(N > 1, (S2 - N) / (N * (N - 1))).alias("simpsons_d"),
        F.sqrt(F.greatest(v_term, F.lit(0.0))).alias("herdan_v"),
        (F.log2(N) - F.col("nlogn") / N).alias("entropy"))


def global_legomena(words: DataFrame, prefix: str = "token") -> DataFrame:
    """Per document with words, how many occur once (twice) in the whole corpus.

    A word with corpus frequency at most two lives in at most two documents, so the first
    and last document id say it all: one aggregation keyed by word, and no join on words,
    where a frequent word would make a hot key.
    """
    rare = (words.groupBy("word")
            .agg(F.sum("n").alias("total"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
            .where("total <= 2"))
    once, twice = f"n_global_{prefix}_hapax_legomena", f"n_global_{prefix}_hapax_dislegomena"
    found = (rare.select("total", F.explode(F.array_distinct(F.array("a", "b"))).alias("doc_id"))
             .groupBy("doc_id").agg(F.count_if(F.col("total") == 1).alias(once),
                                    F.count_if(F.col("total") == 2).alias(twice)))
    return words.select("doc_id").distinct().join(found, "doc_id", "left").na.fill(0, [once, twice])


def global_sichel(words: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Share of a document's types that occur twice in the corpus."""
    types = words.groupBy("doc_id").agg(F.count("*").alias("V"))
    joined = types.join(global_legomena(words), "doc_id", "left")
    return joined.select("doc_id", (F.coalesce("n_global_token_hapax_dislegomena", F.lit(0))
                                    / F.col("V")).alias("global_sichel_s"))


def moving_ttr(tok: DataFrame, window: int = 50, block: int = 1 << 20) -> DataFrame:
    """`mattr`: mean type-token ratio of all windows of `window` tokens.

    A token is the first of its type in exactly the windows that start after the previous
    occurrence of the type, so each token adds a closed-form count instead of a slice per
    position. Occurrences further back than a window do not matter: documents are looked at
    in blocks that share a window of tokens, which bounds the group of a frequent word.
    Shorter documents get their plain ratio.
    """
    here = F.floor(F.col("token_id") / block)
    reaches_on = F.col("token_id") % block >= block - window
    copies = F.array_compact(F.array(
        F.struct(here.alias("block"), F.lit(True).alias("own")),
        F.when(reaches_on, F.struct((here + 1).alias("block"), F.lit(False).alias("own")))))
    placed = tok.select("doc_id", "token_id", F.lower("token").alias("word"),
                        F.inline(copies).alias("block", "own"))
    before = F.lag("token_id").over(W.partitionBy("doc_id", "word", "block").orderBy("token_id"))
    seen = placed.select("doc_id", "token_id", "own", F.coalesce(before, F.lit(-1)).alias("before")) \
        .where("own")
    lengths = tok.groupBy("doc_id").agg(F.count("*").alias("N"))
    size = F.least(F.col("N"), F.lit(window))
    first_start = F.greatest(F.col("before") + 1, F.col("token_id") - size + 1, F.lit(0))
    last_start = F.least(F.col("token_id"), F.col("N") - size)
    adds = F.greatest(last_start - first_start + 1, F.lit(0))
    return (seen.join(lengths, "doc_id").groupBy("doc_id")
            .agg(F.sum(adds).alias("first_seen"), F.max("N").alias("N"))
            .select("doc_id", (F.col("first_seen") / ((F.col("N") - size + 1) * size))
                    .alias("mattr")))


def segment_ttr(tok: DataFrame, size: int = 50) -> DataFrame:
    """`msttr`: mean type-token ratio of full consecutive segments; null without one."""
    segment = F.floor(F.col("token_id") / size)
    return (tok.groupBy("doc_id", segment.alias("segment"), F.lower("token").alias("word"))
            .agg(F.count("*").alias("n"))
            .groupBy("doc_id", "segment").agg(F.count("*").alias("types"), F.sum("n").alias("n"))
            .groupBy("doc_id").agg(
                F.try_divide(F.sum(F.when(F.col("n") == size, F.col("types"))),
                             F.count_if(F.col("n") == size) * size).alias("msttr")))


def hypergeometric_diversity(words: DataFrame, sample: int = 42) -> DataFrame:
    """`hdd`: mean chance that a type shows up in a sample; null for shorter documents.

    Types of a document with the same frequency share their term, so the product runs once
    per distinct frequency; a document has at most sqrt(2 n) of them, gathered in its row.
    """
    spectrum = words.groupBy("doc_id", "n").agg(F.count("*").alias("types")).groupBy("doc_id").agg(
        F.sum(F.col("n") * F.col("types")).alias("total"), F.sort_array(F.collect_list(F.struct("n", "types"))).alias("f"))
    total, draws = F.col("total"), F.sequence(F.lit(0), F.lit(sample - 1))

    # chance that no draw hits: product of (total - n - k) / (total - k)
    def missed(n: Column) -> Column:
        return F.aggregate(draws, F.lit(1.0), lambda acc, k: acc * F.greatest(total - n - k, F.lit(0)) / (total - k))
    share = F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x["types"] * (1 - missed(x["n"])) / sample)
    return spectrum.select("doc_id", F.when(total >= sample, share).alias("hdd"))


def _factor_count(steps: Column, threshold: float) -> Column:
    """Factors of a token sequence given as `at, before`: its place, and the last one of its type.

    A token is new to the factor that started at `start` if its type was last met before that, so a step
    needs no set of types and a document is linear.
    """
    state = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("types"),
                     F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("full"))

    def step(s: Column, x: Column) -> Column:
        start = F.when(s["n"] == 0, x["at"]).otherwise(s["start"])
        types = s["types"] + F.coalesce(x["before"] < start, F.lit(True)).cast("long")
        n = s["n"] + 1
        over = types / n <= threshold
        return F.struct(start.alias("start"), F.when(over, 0).otherwise(types).cast("long").alias("types"),
                        F.when(over, 0).otherwise(n).cast("long").alias("n"),
                        F.when(over, s["full"] + 1).otherwise(s["full"]).alias("full"))

    def finish(s: Column) -> Column:
        return s["full"] + F.when(s["n"] > 0, (1 - s["types"] / s["n"]) / (1 - threshold)).otherwise(0.0)

    return F.aggregate(steps, state, step, finish)


def textual_diversity(tok: DataFrame, threshold: float = 0.72) -> DataFrame:
    """`mtld` of documents given as token rows: the mean length of stretches above the threshold, both ways.

    Each token knows the places of its type's neighbours; a document's pairs of places are gathered
    in its row, and one pass each way counts the factors.
    """
    line = W.partitionBy("doc_id", "word").orderBy("token_id")
    here = F.col("token_id").cast("long")
    linked = tok.select("doc_id", here.alias("at"), "token_id", F.lower("token").alias("word")) \
        .select("doc_id", "at", F.lag("at").over(line).alias("before"), F.lead("at").over(line).alias("behind"))
    rows = linked.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "before", "behind"))).alias("t"))
    there = F.transform("t", lambda x: F.struct(x["at"].alias("at"), x["before"].alias("before")))
    back = F.transform(F.reverse("t"), lambda x: F.struct((-x["at"]).alias("at"), (-x["behind"]).alias("before")))
    counted = rows.select("doc_id", F.size("t").alias("n"), _factor_count(there, threshold).alias("a"),
                          _factor_count(back, threshold).alias("b"))
    each = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.col("n") / F.col(c)) for c in ("a", "b")]))
    return counted.select("doc_id", F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda t, x: t + x) / F.size(each))
                          .alias("mtld"))


# --------------------------------------------------------------------------- complexity
@F.pandas_udf(T.DoubleType())
def _compressed_share(text: pd.Series) -> pd.Series:
    def share(t: str | None) -> float | None:
        raw = (t or "").encode()
        return len(zlib.compress(raw)) / len(raw) if raw else None
    return text.map(share)


def compressibility(docs: DataFrame) -> DataFrame:
    """Compressed over raw bytes of each text."""
    return docs.select("doc_id", _compressed_share("text").alias("compressibility"))


# --------------------------------------------------------------------------- readability
def readability_sums(long_word: int = 6) -> list[Column]:
    """Aggregates over token rows that the readability indices are made of."""
    word, length = F.col("token").rlike(IS_WORD), F.length("token")
    syl = F.when(word, tx.syllables(F.col("token")))
    return [F.count_if(word).alias("W"), F.count_if(F.col("sent_pos") == 0).alias("S"),
            F.sum(F.when(word, length).otherwise(0)).alias("C"), F.count_if(word & (length > long_word)).alias("L"),
            F.coalesce(F.sum(syl), F.lit(0)).cast("long").alias("n_syllables"),
            F.count_if(syl == 1).alias("n_monosyllables"), F.count_if(syl >= 3).alias("n_polysyllables")]


def readability_formulas() -> list[Column]:
    """The indices from the sums."""
    w, s, c, long, syl, poly = (F.col(x).cast("double") for x in
                                ("W", "S", "C", "L", "n_syllables", "n_polysyllables"))
    formulas = {
        "flesch_reading_ease": 206.835 - 1.015 * w / s - 84.6 * syl / w,
        "flesch_kincaid_grade": 0.39 * w / s + 11.8 * syl / w - 15.59,
        "gunning_fog": 0.4 * (w / s + 100 * poly / w),
        "ari": 4.71 * c / w + 0.5 * w / s - 21.43,
        "smog": 1.043 * F.sqrt(30 * poly / s) + 3.1291,
        "cli": 0.0588 * (100 * c / w) - 0.296 * (100 * s / w) - 15.8,
        "lix": w / s + 100 * long / w,
        "rix": long / s,
    }
    return [F.col("n_syllables"), F.col("n_monosyllables"), F.col("n_polysyllables"),
            *[F.when(w > 0, f).alias(n) for n, f in formulas.items()]]


def readability(tok: DataFrame, long_word: int = 6) -> DataFrame:
    """Readability indices. Words are tokens with a letter or digit."""
    return tok.groupBy("doc_id").agg(*readability_sums(long_word)).select("doc_id", *readability_formulas())
