"""Style features: counts, denominators and vectors.

One pass over the token table emits an item for each feature; batches of tokens count them, and a final
aggregation adds up. The first shuffle is keyed by document and item, so one huge
document spreads over many tasks; the second gathers at most one entry per vocabulary item
of a document. On a table bucketed by document neither shuffle is needed.

Profiles:

* ``style``: rates per token for words, punctuation, emoji and constructions; bigrams with
  sentence boundary marks in the denominator; the rest per feature total.
* ``simple``: every feature per its own total, plain adjacent bigrams, lower-cased function
  words, punctuation as whole tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.functions import text as tx
from styloweave.operators import syntax
from styloweave.session import BROADCAST_ROWS

SCALARS = {"tokens": "count", "num_tokens": "num_tokens", "types": "count",
           "sentence_count": "count", "transitions": "count", "unique_transitions": "count"}
PER_TOKEN = {"func_words", "punctuation", "sentences", "emojis"}
ITEM = "struct<feature:string,item:string,idx:int,n:bigint>"


def default_vocabs() -> dict[str, list[str]]:
    return {
        "pos_unigrams": fv.POS_TAGS,
        "pos_bigrams": fv.pos_bigrams_vocab(),
        "dep_labels": fv.DEP_LABELS,
        "morph_tags": fv.MORPH_TAGS,
        "sentences": fv.CONSTRUCTIONS,
        "emojis": fv.EMOJIS,
        "func_words": fv.func_words_vocab(),
        "punctuation": fv.PUNCTUATION,
        "letters": fv.letters_vocab(),
        "transitions": fv.transitions_vocab(),
    }


def default_config(**switches: int) -> dict[str, int]:
    """All features on; pass `name=0` to switch one off."""
    return {f: 1 for f in fv.STYLE_FEATURES} | switches


def enabled_features(config: dict[str, int] | None) -> list[str]:
    """Features in output order; a feature missing from the config is on."""
    config = config or {}
    return [f for f in fv.STYLE_FEATURES if config.get(f, 1)]


def vector_columns(config: dict[str, int] | None = None,
                   vocabs: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """`(feature, item)` of each vector position. Features without a vocabulary have none."""
    vocabs = vocabs or default_vocabs()
    columns: dict[tuple[str, str], None] = {}
    for feature in enabled_features(config):
        if feature in SCALARS:
            columns[(feature, SCALARS[feature])] = None
        else:
            columns.update({(feature, item): None for item in vocabs.get(feature, [])})
    return list(columns)


def column_table(spark: SparkSession, columns: list[tuple[str, str]]) -> DataFrame:
    """Vector positions as `feature, item, idx`; made on the driver, so its size is known."""
    table = spark.createDataFrame([(f, i, n) for n, (f, i) in enumerate(columns)],
                                  "feature string, item string, idx int")
    return F.broadcast(table) if len(columns) <= BROADCAST_ROWS else table


# ------------------------------------------------------------------------------- counting
#: Stands for the name of an item outside the vocabulary until counting is done.
UNLISTED = "\x00unlisted"
# Larger vocabularies are looked up after counting only; the rows are the same.
LITERAL_VOCAB = 2_000


def _emissions(features: list[str], vocabs: dict[str, list[str]], open_features: list[str],
               profile: str) -> list[tuple[str, Column]]:
    """The item that one token contributes to each feature: null for none, `UNLISTED` for one without a name.

    Items outside the vocabulary are dropped, or lose their name where they count in the
    denominator, so they never reach the shuffle. Split features send the unsplit text.
    """
    token, simple = F.col("token"), profile == "simple"
    pairs: list[tuple[str, Column]] = [("tokens", F.lit("count"))]

    def emit(feature: str, item: Column, when: Column | None = None) -> None:
        known = None if feature in _split_features(profile) else _listed(feature, item, vocabs)
        if known is not None and feature in open_features:
            item = F.when(known, item)
        elif known is not None:
            when = known if when is None else when & known
        item = F.coalesce(item, F.lit(UNLISTED))
        pairs.append((feature, item if when is None else F.when(when, item)))

    emit("sentence_count", F.lit("count"), F.col("sent_pos") == 0)
    if "pos_unigrams" in features:
        emit("pos_unigrams", F.col("pos"))
    if "dep_labels" in features:
        emit("dep_labels", F.col("dep"))
    if "pos_bigrams" in features:
        emit("pos_bigrams", F.concat_ws(" ", "pos", "next_pos"), F.col("next_pos").isNotNull())
    if "func_words" in features:
        emit("func_words", F.lower(token) if simple else token)
    if "types" in features:
        emit("types", F.lower(token))
    for verbs in ("suasive_verbs", "stative_verbs"):
        if verbs in features:
            emit(verbs, F.lower("lemma"))
    if "named_entities" in features:
        emit("named_entities", F.col("ent_type"), F.col("ent_start"))
    if "morph_tags" in features:
        emit("morph_tags", F.col("morph"), F.col("morph") != "")
    if "punctuation" in features:
        # plain words hold no punctuation, unless the vocabulary names letters
        letters = any(c.isascii() and c.isalpha() for i in vocabs.get("punctuation", []) for c in i)
        emit("punctuation", token, F.col("is_punct") if simple
             else None if letters else ~token.rlike(r"^[a-zA-Z]+$"))
    if "letters" in features:
        emit("letters", token)
    return pairs


def _exploded_pairs(tok: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    """`doc_id, feature, item, n` of each token, by one compiled explode that keeps the table's buckets."""
    each = [F.when(c.isNotNull(), F.struct(F.lit(f).alias("feature"), F.when(c != UNLISTED, c).alias("item"))) for f, c in pairs]
    return (tok.select("doc_id", F.explode(F.array(*each)).alias("p")).where(F.col("p").isNotNull())
            .select("doc_id", "p.feature", "p.item", F.lit(1).cast("long").alias("n")))


def counted_by_batch(tok: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    """`doc_id, feature, item, n` of every batch of tokens: what a partial aggregation does, by codes instead of rows.

    Batches need no order; the more tokens of a document one holds, the fewer rows leave it.
    """
    features = [feature for feature, _ in pairs]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).dictionary_encode(null_encoding="encode")
            own, n_ids = ids.indices.to_numpy().astype(np.int64), max(1, len(ids.dictionary))
            for feature, column in zip(features, batch.columns[1:]):
                column = column.dictionary_encode()
                items = column.dictionary
                here = column.indices.is_valid().to_numpy(zero_copy_only=False)
                codes = column.indices.fill_null(0).to_numpy().astype(np.int64)
                held, n = np.unique((codes * n_ids + own)[here], return_counts=True)
                named = items.take(pa.array(held // n_ids))
                unnamed = pc.equal(named, UNLISTED)
                yield pa.RecordBatch.from_arrays(
                    [ids.dictionary.take(pa.array(held % n_ids)), pa.array([feature] * len(held), pa.string()),
                     pc.if_else(unnamed, pa.scalar(None, pa.string()), named), pa.array(n, pa.int64())],
                    names=["doc_id", "feature", "item", "n"])

    kind = tok.schema["doc_id"].dataType.simpleString()
    return tok.select("doc_id", *[c.alias(f"c{n}") for n, (_, c) in enumerate(pairs)]) \
        .mapInArrow(counted, f"doc_id {kind}, feature string, item string, n bigint")


def _split_features(profile: str) -> dict[str, str]:
    """Features counted by part of a token's text, with the separator."""
    parts = {"morph_tags": r"\|", "letters": ""}
    return parts if profile == "simple" else parts | {"punctuation": ""}


def _listed(feature: str, item: Column, vocabs: dict[str, list[str]]) -> Column | None:
    items = list(dict.fromkeys(vocabs.get(feature, [])))
    return item.isin(items) if feature in vocabs and len(items) <= LITERAL_VOCAB else None


def _split_items(pairs: DataFrame, features: list[str], vocabs: dict[str, list[str]],
                 open_features: list[str], profile: str) -> DataFrame:
    """Characters and tags of the split features; other items pass as they are."""
    splits = {f: sep for f, sep in _split_features(profile).items() if f in features}
    if not splits:
        return pairs
    feature, item = F.col("feature"), F.col("item")
    parts, wanted, named = None, F.lit(True), None
    for name, sep in splits.items():
        cut = F.split(item, sep)
        parts = F.when(feature == name, cut) if parts is None else parts.when(feature == name, cut)
        known = _listed(name, F.col("part"), vocabs)
        if name in open_features:
            ok = F.col("part") != ""
            if name == "letters":
                ok = tx.is_alphabetic(F.col("part"))
            if known is not None:
                drop = (feature == name) & ~known
                named = F.when(drop, None) if named is None else named.when(drop, None)
        else:
            ok = known if known is not None else F.col("part") != ""
        wanted = wanted & ((feature != name) | ok)
    out = (pairs.select("doc_id", "feature", "n", F.explode(parts.otherwise(F.array(item)))
                        .alias("part")).where(wanted))
    part = F.col("part") if named is None else named.otherwise(F.col("part"))
    return out.select("doc_id", "feature", part.alias("item"), "n")


def _open_features(features: list[str], profile: str, letters: str) -> list[str]:
    """Features whose denominator includes items outside the vocabulary."""
    kept = {"pos_unigrams", "dep_labels", "morph_tags", "named_entities"}
    if letters == "single" or profile == "simple":
        kept.add("letters")
    if profile == "simple":
        kept |= {"pos_bigrams", "punctuation", "emojis"}
    return [f for f in features if f in kept]


def _counted(pairs: DataFrame, table: DataFrame, open_features: list[str]) -> DataFrame:
    """Count pairs, then look up their vector positions: the join sees counts, not tokens."""
    counts = pairs.groupBy("doc_id", "feature", "item").agg(F.sum("n").alias("n"))
    unlisted = F.col("feature").isin("tokens", "sentence_count", "types", "transitions",
                                     *open_features)
    return (counts.join(table, ["feature", "item"], "left")
            .where(F.col("idx").isNotNull() | unlisted)
            .select("doc_id", "feature", "item", "idx", "n"))


def _unnamed(counts: DataFrame, open_features: list[str]) -> DataFrame:
    """One row without a name for the unlisted items of a feature, as for small vocabularies."""
    unlisted = F.col("idx").isNull() & F.col("feature").isin(open_features)
    return (counts.withColumn("item", F.when(~unlisted, F.col("item")))
            .groupBy("doc_id", "feature", "item", "idx").agg(F.sum("n").alias("n")))


def transition_matches(tok: DataFrame, transitions: list[str] | None = None,
                       quote_ok: bool = False) -> DataFrame:
    """Sentences opened by a transition and a comma, also after `and` or `but`.

    Returns `doc_id, sentence_id, transition`; the first listed transition wins. A comma
    must be followed by another token. A leading quotation mark spoils the match unless
    `quote_ok`.

    Only words of the transitions near a sentence start are shuffled. Any other word leaves
    a gap in the positions before the comma, which rules the sentence out.
    """
    transitions = transitions if transitions is not None else fv.transitions_vocab()
    spark, glue = tok.sparkSession, "\x1f"
    phrases = [t.lower().split() for t in transitions]
    longest = max(map(len, phrases), default=1)
    table = F.broadcast(spark.createDataFrame(
        [(glue.join(p), t.lower(), n) for n, (p, t) in enumerate(zip(phrases, transitions))],
        "phrase string, transition string, ord int"))
    quotes, joiners = ["'", '"'], ["and", "but"]
    words = sorted({w for p in phrases for w in p} | {",", *joiners} | set(quotes))
    low = F.lower("token")
    last = F.col("is_last") if "is_last" in tok.columns else F.col("next_pos").isNull()
    near = tok.where((F.col("sent_pos") <= longest + 2) & low.isin(words)).select(
        "doc_id", "sentence_id", "sent_pos", low.alias("t"), last.alias("last"))
    openings = (near.groupBy("doc_id", "sentence_id")
                .agg(F.min("sent_pos").alias("first"), F.bool_or(F.col("t") == ",").alias("comma"),
                     F.sort_array(F.collect_list(F.struct("sent_pos", "t", "last"))).alias("o"))
                .where("first = 0 and comma"))
    at = F.array_position("o.t", ",").cast("int")
    framed = (openings.select("doc_id", "sentence_id", "o", at.alias("at"))
              .where((F.col("at") > 1) & (F.get("o", F.col("at") - 1).sent_pos == F.col("at") - 1)
                     & ~F.get("o", F.col("at") - 1).last)
              .select("doc_id", "sentence_id",
                      F.slice("o.t", F.lit(1), F.col("at") - 1).alias("t")))
    if quote_ok:
        framed = framed.select("doc_id", "sentence_id", F.when(
            F.get("t", F.lit(0)).isin(quotes), F.slice("t", 2, F.size("t"))).otherwise(F.col("t"))
            .alias("t"))
    rest = F.array_join(F.slice("t", 2, F.size("t")), glue)
    after = F.when(F.get("t", F.lit(0)).isin(joiners), rest)
    return (framed.select("doc_id", "sentence_id",
                          F.explode(F.array(F.array_join("t", glue), after)).alias("phrase"))
            .join(table, "phrase")
            .groupBy("doc_id", "sentence_id")
            .agg(F.min_by("transition", "ord").alias("transition")))


def _emoji_runs(tok: DataFrame) -> DataFrame:
    """`doc_id, t`: runs of adjacent emoji tokens, so that sequences a tokenizer has cut are whole."""
    cut = tok.where(F.col("token").rlike(tx.EMOJI_PART)).groupBy("doc_id", "sentence_id").agg(
        F.sort_array(F.collect_list(F.struct("token_id", "token"))).alias("c"))
    return cut.select("doc_id", F.array_join(F.transform("c", lambda x, i: F.concat(F.when(
        F.coalesce(F.get("c", i - 1).token_id, F.lit(-2)) == x.token_id - 1, "").otherwise(" "), x.token)), "").alias("t"))


def doc_bigrams(tok: DataFrame) -> DataFrame:
    """Adjacent part-of-speech pairs over the document, across sentence ends.

    Pairs inside a sentence come from the token row. The rest meet on the position between
    two sentences, so no window over the whole document is needed.
    """
    inside = (tok.where(F.col("next_pos").isNotNull())
              .select("doc_id", F.concat_ws(" ", "pos", "next_pos").alias("item")))
    ends = tok.where(F.col("next_pos").isNull() | (F.col("sent_pos") == 0)).select(
        "doc_id", F.explode(F.array_compact(F.array(
            F.when(F.col("next_pos").isNull(), F.struct(
                (F.col("token_id") + 1).alias("at"), F.col("pos").alias("left"),
                F.lit(None).cast("string").alias("right"))),
            F.when(F.col("sent_pos") == 0, F.struct(
                F.col("token_id").alias("at"), F.lit(None).cast("string").alias("left"),
                F.col("pos").alias("right")))))).alias("e"))
    across = (ends.select("doc_id", "e.*").groupBy("doc_id", "at")
              .agg(F.max("left").alias("left"), F.max("right").alias("right"))
              .where("left is not null and right is not null")
              .select("doc_id", F.concat_ws(" ", "left", "right").alias("item")))
    return inside.unionByName(across)


def feature_counts(tok: DataFrame, *, docs: DataFrame | None = None,
                   config: dict[str, int] | None = None,
                   vocabs: dict[str, list[str]] | None = None, profile: str = "style",
                   letters: str = "batch", patterns: dict[str, str] | None = None,
                   quote_ok: bool = False, extra: list[DataFrame] = (), trees: DataFrame | None = None,
                   openings: DataFrame | None = None, by_batch: bool = False) -> DataFrame:
    """`doc_id, feature, item, idx, n`.

    `item` is null for occurrences outside the vocabulary that count in a denominator. For
    `types` and `transitions` there is one row per distinct word or transition.

    `letters='single'` takes all alphabetic characters as the denominator of letters,
    `'batch'` only those in the vocabulary. `extra` holds user features as
    `doc_id, feature, item, n`. `trees` are the linear trees of `tok`, if known, and `openings`
    its tokens from a source that is read sooner; of those only words, sentences and their ends are looked at.
    `by_batch` counts batches of tokens first, which gives up the buckets of a stored table.
    """
    vocabs = vocabs or default_vocabs()
    features = enabled_features(config)
    if profile == "simple":
        features = [f for f in features if f != "num_tokens"]
    spark = tok.sparkSession
    table = column_table(spark, vector_columns(config, vocabs) + [
        (f, i) for f in _user_features(vocabs) for i in vocabs[f]])
    open_features = _open_features(features, profile, letters)
    needs_vocab = {"suasive_verbs", "stative_verbs"}
    emitted = [f for f in features if f not in needs_vocab or vocabs.get(f)]
    if profile == "simple":
        emitted = [f for f in emitted if f != "pos_bigrams"]

    told, emissions = tok.where(F.col("token").isNotNull()), _emissions(emitted, vocabs, open_features, profile)
    pairs = counted_by_batch(told, emissions) if by_batch else _exploded_pairs(told, emissions)
    pairs = _split_items(pairs, emitted, vocabs, open_features, profile)
    one = F.lit(1).cast("long").alias("n")
    def also(items: DataFrame, feature: str) -> None:
        nonlocal pairs
        pairs = pairs.unionByName(
            items.select("doc_id", F.lit(feature).alias("feature"), "item", one))

    if profile == "simple" and "pos_bigrams" in features:
        also(doc_bigrams(tok), "pos_bigrams")
    if "emojis" in features:
        texts = docs.select("doc_id", F.col("text").alias("t")) if docs is not None else _emoji_runs(tok)
        also(texts.where(F.col("t").rlike(tx.EMOJI_NEEDS)).select("doc_id", F.explode(tx.emojis_of(F.col("t"))).alias("item")),
             "emojis")
    if {"transitions", "unique_transitions"} & set(features):
        also(transition_matches(tok if openings is None else openings, vocabs.get("transitions"), quote_ok)
             .withColumnRenamed("transition", "item"), "transitions")
    if "sentences" in features:
        found = syntax.matches_in_trees(syntax.linear_trees(tok) if trees is None else trees, patterns)
        also(found.select("doc_id", F.col("pattern_name").alias("item")), "sentences")
    for more in extra:
        pairs = pairs.unionByName(more.select("doc_id", "feature", "item",
                                              F.col("n").cast("long").alias("n")))
    counts = _counted(pairs, table, open_features)
    late = any(len(set(vocabs.get(f, []))) > LITERAL_VOCAB for f in open_features) or not \
        set(open_features) <= set(vocabs) | {"letters"}
    return _unnamed(counts, open_features) if late else counts


def _user_features(vocabs: dict[str, list[str]]) -> list[str]:
    return [f for f in vocabs if f not in fv.STYLE_FEATURES]


# ------------------------------------------------------------------------------- vectors
def style_profiles(counts: DataFrame, *, docs: DataFrame | None = None,
                   config: dict[str, int] | None = None,
                   vocabs: dict[str, list[str]] | None = None,
                   profile: str = "style") -> DataFrame:
    """One row per document: `doc_id, n_tokens, n_sents, items`, items sorted by position.

    Each item is `(feature, item, idx, n, denom, value)`; absent items are zero. Give `docs`
    to keep documents without tokens, and their other columns but the text.
    """
    columns = vector_columns(config, vocabs)
    at = {c: n for n, c in enumerate(columns)}
    features = {f for f, _ in columns}
    vocabs = vocabs or default_vocabs()
    user = _user_features(vocabs)
    listed = sorted(features - set(SCALARS)) + user
    feature, n = F.col("feature"), F.col("n")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(feature == name, n)), F.lit(0)).cast("long")

    # distinct words are counted before documents are gathered, as they are most of the rows
    of_words = feature == "types"
    counts = counts.groupBy("doc_id", "feature", F.when(~of_words, F.col("item")).alias("item"), "idx").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_items"))
    gathered = counts.groupBy("doc_id").agg(
        total("tokens").alias("n_tokens"), total("sentence_count").alias("n_sents"),
        F.coalesce(F.sum(F.when(of_words, F.col("n_items"))), F.lit(0)).cast("long").alias("n_types"),
        total("transitions").alias("n_transitions"),
        F.count_if(feature == "transitions").alias("n_unique_transitions"),
        F.struct(*[total(f).alias(f) for f in listed or ["tokens"]]).alias("totals"),
        F.collect_list(F.when(F.col("idx").isNotNull() & feature.isin(listed), F.struct(
            "feature", "item", "idx", "n"))).alias("hits"))
    if docs is not None:
        gathered = docs.drop("text").join(gathered, "doc_id", "left")
    zero = F.lit(0).cast("long")
    of_scalar = {"tokens": "n_tokens", "num_tokens": "n_tokens", "types": "n_types",
                 "sentence_count": "n_sents", "transitions": "n_transitions",
                 "unique_transitions": "n_unique_transitions"}
    scalars = [F.struct(F.lit(f).alias("feature"), F.lit(i).alias("item"),
                        F.lit(at[(f, i)]).alias("idx"),
                        F.coalesce(F.col(of_scalar[f]), zero).alias("n"))
               for f, i in columns if f in SCALARS]
    found = F.coalesce(F.col("hits"), F.array().cast(f"array<{ITEM}>"))
    every = F.concat(found, F.array(*scalars)) if scalars else found

    def denominator(x: Column) -> Column:
        tokens = F.coalesce(F.col("n_tokens"), zero)
        denom = F.when(x.feature.isin(list(SCALARS)), F.lit(1).cast("long"))
        for f in listed:
            if profile == "style" and f in PER_TOKEN:
                d = tokens
            elif profile == "style" and f == "pos_bigrams":
                d = tokens + 2 * F.coalesce(F.col("n_sents"), zero) - 1
            else:
                d = F.coalesce(F.col("totals")[f], zero)
            denom = denom.when(x.feature == f, F.greatest(d, F.lit(1).cast("long")))
        return denom

    def normalised(x: Column) -> Column:
        d = denominator(x)
        return F.struct(x.idx.alias("idx"), x.feature.alias("feature"), x.item.alias("item"),
                        x.n.alias("n"), d.alias("denom"), (x.n / d).alias("value"))

    others = [c for c in docs.columns if c not in ("doc_id", "text")] if docs is not None else []
    return gathered.select(
        "doc_id", *others, F.coalesce("n_tokens", zero).alias("n_tokens"),
        F.coalesce("n_sents", zero).alias("n_sents"),
        F.sort_array(F.transform(every, normalised)).alias("items"))


def vectorize(tok: DataFrame, *, docs: DataFrame | None = None,
              config: dict[str, int] | None = None,
              vocabs: dict[str, list[str]] | None = None, profile: str = "style",
              **how) -> DataFrame:
    """Token table to one row per document (see `style_profiles`)."""
    if profile == "simple":
        config = (config or {}) | {"num_tokens": 0}
    counts = feature_counts(tok, docs=docs, config=config, vocabs=vocabs, profile=profile, **how)
    return style_profiles(counts, docs=docs, config=config, vocabs=vocabs, profile=profile)


def sparse_long(profiles: DataFrame, keep: list[str] = ()) -> DataFrame:
    """`doc_id, feature, item, n, denom, value` of the items present."""
    return (profiles.select("doc_id", *keep, F.explode("items").alias("x"))
            .select("doc_id", *keep, "x.feature", "x.item", "x.n", "x.denom", "x.value"))


def dense_array(width: int, items: str = "items") -> Column:
    """Values at all positions, zeros filled in between the sorted items; linear time."""
    zero = F.lit(0.0)
    last = F.when(F.size(items) > 0, F.element_at(items, -1).idx).otherwise(F.lit(-1))
    filled = F.flatten(F.transform(items, lambda x, i: F.concat(
        F.array_repeat(zero, x.idx - 1 - F.coalesce(F.get(items, i - 1).idx, F.lit(-1))),
        F.array(x.value))))
    return F.concat(filled, F.array_repeat(zero, F.lit(width - 1) - last))


def dense_long(profiles: DataFrame, columns: list[tuple[str, str]],
               keep: list[str] = ()) -> DataFrame:
    """`doc_id, feature, item, value` for every document and vector position."""
    table = column_table(profiles.sparkSession, columns)
    return (profiles.select("doc_id", *keep, F.posexplode(dense_array(len(columns)))
                            .alias("idx", "value"))
            .join(table, "idx").select("doc_id", *keep, "feature", "item", "value"))


def wide(profiles: DataFrame, columns: list[tuple[str, str]], chosen: list[str] | None = None,
         keep: list[str] = ()) -> DataFrame:
    """One `feature:item` column per vector position, or per chosen name."""
    names = [f"{f}:{i}" for f, i in columns]
    at = {name: n for n, name in enumerate(names)}
    dense = profiles.select("doc_id", *keep, dense_array(len(columns)).alias("v"))
    return dense.select("doc_id", *keep, *[
        F.get("v", F.lit(at[name])).alias(name) for name in (chosen or names)])
