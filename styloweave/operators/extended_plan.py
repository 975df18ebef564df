"""The extended measures of a configuration together, by the tables that they read.

Tokens are stored once, narrowed to the columns that are asked for, unless what several measures read is given. One aggregation by document gives
what is summed over tokens (surface, lexical classes, readability, hedges, entities); one shuffle of
(document, kind, key) gives the counts of words, lemmas, classes, features and relations, from which
richness, rare words, lexicon measures and counts by key follow. Only measures of word order (moving ratios,
factor lengths) and of trees read the tokens again. All results are keyed by document and meet by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.functions import text as tx
from styloweave.operators import extended as ex
from styloweave.operators import lexicon as lx
from styloweave.session import kept

COLUMNS = ("doc_id sentence_id token_id sent_pos token lemma pos tag morph dep head_token_id ent_type ent_start "
           "is_punct next_pos").split()
PER_KEY = {"n_per_pos": "pos", "n_per_morph_feature": "morph", "n_per_dependency_type": "dep", "n_per_entity_type": "entity"}
ORDERED = {"mattr": ex.moving_ttr, "msttr": ex.segment_ttr, "mtld": ex.textual_diversity}
SURFACE = "n_tokens n_sentences n_characters n_long_words".split()


def all_families() -> dict[str, list[str]]:
    return {family: list(names) for family, names in fv.EXTENDED_FAMILIES.items()}


def _kinds(wanted: set[str]) -> list[Column]:
    """(kind, key) of a token, one array for each kind that is counted."""
    one = {"token": F.lower("token"), "lemma": F.lower("lemma")}
    if "n_per_pos" in wanted or "pos_variability" in wanted:
        one["pos"] = F.col("pos")
    if "n_per_dependency_type" in wanted:
        one["dep"] = F.col("dep")
    arrays = [F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in one.items()])]
    if "n_per_morph_feature" in wanted:
        features = F.filter(F.split(F.coalesce("morph", F.lit("")), r"\|"), lambda m: m != "")
        arrays.append(F.transform(features, lambda m: F.struct(F.lit("morph").alias("kind"), m.alias("key"))))
    if "n_per_entity_type" in wanted:
        arrays.append(F.when(F.col("ent_start"), F.array(F.struct(F.lit("entity").alias("kind"), F.col("ent_type").alias("key"))))
                      .otherwise(F.array().cast("array<struct<kind:string,key:string>>")))
    return arrays


def _of(kind: str) -> Column:
    return F.col("kind") == kind


def key_counts(tokens: DataFrame, wanted: set[str] = frozenset(PER_KEY)) -> DataFrame:
    """`doc_id, kind, key, n`: words, lemmas and what the measures in `wanted` count by key."""
    return tokens.select("doc_id", F.explode(F.concat(*_kinds(wanted))).alias("e")) \
        .groupBy("doc_id", "e.kind", "e.key").agg(F.count("*").alias("n"))


def extended_features(tok: DataFrame, docs: DataFrame, families: dict[str, list[str]] | None = None, *,
                      hedges: list[str] = (), measures: dict[str, tuple] | None = None,
                      lexicon: DataFrame | None = None, shapes: DataFrame | None = None,
                      counts: DataFrame | None = None, ratios: DataFrame | None = None) -> DataFrame:
    """One row per document with tokens: the measures of `families` (all by default).

    Measures by key are maps. `measures` and `lexicon` are those of `lexicon_measures`. Noun chunks are
    counted from spans elsewhere (`span_counts`); `compressibility` reads the texts. `shapes` are those of the sentences
    (`syntax.ordered_shapes`), if known; `counts` those by key (`key_counts`) and `ratios` a row of `mattr, msttr` for each
    document, if known. Tokens are stored where several measures read them.
    """
    families = families if families is not None else all_families()
    wanted = {name for names in families.values() for name in names} - {"n_noun_chunks"}
    tokens = tok.select(*[c for c in COLUMNS if c in tok.columns])
    ordered = [name for name in ORDERED if name in wanted and (ratios is None or name not in ratios.columns)]
    if counts is None or ordered or shapes is None and wanted & {"tree_width", "tree_depth", "tree_branching"}:
        tokens = kept(tokens)
    counts = kept(key_counts(tokens, wanted)) if counts is None else counts
    out = [_summed(tokens, docs, hedges), _counted(counts)]
    words = counts.where(_of("token")).select("doc_id", F.col("key").alias("word"), "n")
    lemmas = counts.where(_of("lemma")).select("doc_id", F.col("key").alias("word"), "n")
    for prefix, table in (("token", words), ("lemma", lemmas)):
        if any(name.startswith(f"n_global_{prefix}") for name in wanted) or prefix == "token" and "global_sichel_s" in wanted:
            out.append(ex.global_legomena(table, prefix))
    if "hdd" in wanted:
        out.append(ex.hypergeometric_diversity(words))
    out += [ORDERED[name](tokens) for name in ordered] + ([ratios] if ratios is not None else [])
    if wanted & {"tree_width", "tree_depth", "tree_branching"}:
        out.append(ex.tree_measures(tokens, shapes))
    if "compressibility" in wanted:
        out.append(ex.compressibility(docs))
    if measures:
        wanted |= {c for c in lx.lexicon_columns(measures)}
        out.append(lx.measures_of(lemmas.withColumnRenamed("word", "key"), lexicon, measures))
    joined = reduce(lambda a, b: a.join(b, "doc_id", "left"), out)
    if "global_sichel_s" in wanted:
        joined = joined.withColumn("global_sichel_s", F.col("n_global_token_hapax_dislegomena") / F.col("n_types"))
    return joined.select("doc_id", *sorted(c for c in joined.columns if c in wanted))


def _summed(tokens: DataFrame, docs: DataFrame, hedges: list[str]) -> DataFrame:
    """What is summed over the tokens of a document, in one aggregation."""
    length, lexical = F.length("token"), F.col("pos").isin(fv.LEXICAL_POS)
    sums = tokens.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.count_if(F.col("sent_pos") == 0).alias("n_sentences"),
        F.sum(length).alias("n_characters"), F.count_if(length > 6).alias("n_long_words"),
        F.count_if(lexical).alias("n_lexical_tokens"), F.count_if("ent_start").alias("n_entities"),
        F.count_if(F.lower("token").isin([w.lower() for w in hedges])).alias("n_hedges"), *ex.readability_sums())
    raw = docs.select("doc_id", tx.text_length(F.col("text")).alias("raw_sequence_length"))
    n = F.col("n_tokens")
    return sums.join(raw, "doc_id").select(
        "doc_id", "raw_sequence_length", *SURFACE, (n / F.col("n_sentences")).alias("n_tokens_per_sentence"),
        (F.col("n_characters") / n).alias("avg_word_length"), "n_lexical_tokens",
        (F.col("n_lexical_tokens") / n).alias("lexical_density"), "n_entities", "n_hedges", *ex.readability_formulas())


def _counted(counts: DataFrame) -> DataFrame:
    """Richness of words and lemmas, and the counts by key, from one aggregation of the counts."""
    both = ex.richness(counts.where("kind IN ('token', 'lemma')"), ["doc_id", "kind"])
    measures = [c for c in both.columns if c not in ("doc_id", "kind", "n_tokens")]
    rich = both.groupBy("doc_id").agg(
        *[F.max(F.when(_of("token"), F.col(c))).alias(c) for c in measures],
        F.max(F.when(_of("lemma"), F.col("n_types"))).alias("n_lemmas"),
        F.max(F.when(_of("lemma"), F.col("ttr"))).alias("lemma_token_ratio"))
    entry = F.struct("key", "n")
    maps = counts.where("kind NOT IN ('token', 'lemma')").groupBy("doc_id").agg(
        *[F.map_from_entries(F.sort_array(F.collect_list(F.when(_of(kind), entry)))).alias(name)
          for name, kind in PER_KEY.items()],
        (F.count_if(_of("pos")) / F.sum(F.when(_of("pos"), F.col("n")))).alias("pos_variability"))
    return rich.join(maps, "doc_id", "left")
