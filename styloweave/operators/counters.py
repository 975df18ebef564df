"""Named document counters: one wide row per document.

Plain counters share one aggregation with map-side partial results, so a document costs one
row in the shuffle. Distinct words and children of tokens have their own keyed aggregations;
only the parts that the requested names need are planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.operators import style

LONG = "long"


def _plain() -> dict[str, Column]:
    """Counters that look at one token at a time."""
    low, tag, pos = F.lower("token"), F.col("tag"), F.col("pos")
    mark = F.col("is_punct")
    entity = F.col("ent_start")
    anonymous = F.count_if(F.col("token") == fv.PERSON_PLACEHOLDER)
    count_if = F.count_if
    out = {name: count_if(pos == value) for name, value in fv.COUNTED_POS.items()}
    out |= {"sentences": count_if(F.col("sent_pos") == 0),
            "func_words": count_if("is_stop"), "punctuation": count_if(mark)}
    out |= {f"punct_{kind}": count_if(mark & (F.col("token") == ch))
            for kind, ch in fv.PUNCT_TYPES.items()}
    for kind, ch in (("period", "."), ("question", "?"), ("exclamation", "!")):
        out[f"sent_punct_{kind}"] = count_if(mark & (F.col("token") == ch))
    out |= {"tokens": F.count("*"),
            "named_entities": count_if(entity) + anonymous,
            "NEs_person": count_if(entity & (F.col("ent_type") == "PERSON")) + anonymous,
            "NEs_without_date": count_if(entity & (F.col("ent_type") != "DATE")) + anonymous}
    out |= {name: count_if(entity & (F.col("ent_type") == label))
            for name, label in fv.COUNTED_ENTITIES.items()}
    out |= {f"token_{t}": count_if(tag == t) for t in fv.COUNTED_TAGS}
    out |= {"token_superlatives": count_if(tag.isin("JJS", "RBS")),
            "first_person_pronouns": count_if(low.isin(fv.FIRST_PERSON)),
            "second_person_pronouns": count_if(low.isin(fv.SECOND_PERSON)),
            "third_person_pronouns": count_if(low.isin(fv.THIRD_PERSON)),
            "pronoun_it": count_if(low == "it"),
            "avg_chars_per_token": F.avg(F.length("token")),
            "avg_tokens_per_sentence": F.count("*") / count_if(F.col("sent_pos") == 0)}
    return out


MAPS = ["pos_tags", "token_tags", "dep_labels", "morph_tags", "pos_bigrams"]
DISTINCT = ["types", "avg_types_per_sentence"]
TREE = ["avg_verb_chunk_length", "copula_verbs", "stative_verbs"]
OPENING = ["transition_words", "unique_transitions"]
# Names of the counters in output order.
ALL = """
pos_tags token_tags pos_verbs pos_adjectives pos_adverbs pos_proper_nouns pos_adpositions
pos_interjections pos_nouns pos_pronouns dep_labels morph_tags pos_bigrams transition_words
unique_transitions sentences func_words punctuation punct_periods punct_commas punct_colons
punct_semicolons punct_exclamations punct_questions sent_punct_period sent_punct_question
sent_punct_exclamation tokens types named_entities NEs_person NEs_location_loc
NEs_location_gpe NEs_organization NEs_date NEs_without_date token_VB token_VBD token_VBG
token_VBN token_VBP token_VBZ token_EX token_FW token_PRP token_superlatives
first_person_pronouns second_person_pronouns third_person_pronouns pronoun_it
avg_noun_chunk_length avg_verb_chunk_length avg_chars_per_token avg_tokens_per_sentence
avg_types_per_sentence copula_verbs suasive_verbs stative_verbs
""".split()


def map_counts(tok: DataFrame, kinds: list[str] = MAPS) -> DataFrame:
    """`doc_id, kind, key, n` of the counters that are dictionaries."""
    parts = {
        "pos_tags": F.array(F.col("pos")), "token_tags": F.array(F.col("tag")),
        "dep_labels": F.array(F.col("dep")),
        # a token without morphology counts under the empty key
        "morph_tags": F.split(F.coalesce("morph", F.lit("")), r"\|"),
    }
    wanted = [k for k in kinds if k in parts]
    rows = tok.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), parts[k].alias("keys")) for k in wanted])).alias("e")) \
        .select("doc_id", "e.kind", F.explode("e.keys").alias("key")) if wanted else None
    if "pos_bigrams" in kinds:
        pairs = style.doc_bigrams(tok).select(
            "doc_id", F.lit("pos_bigrams").alias("kind"),
            F.translate("item", " ", "_").alias("key"))
        rows = pairs if rows is None else rows.unionByName(pairs)
    return rows.groupBy("doc_id", "kind", "key").agg(F.count("*").alias("n"))


def _maps(tok: DataFrame, kinds: list[str]) -> DataFrame:
    """One map column per kind; a map holds at most one entry per tag of the tag set."""
    entry = F.struct("key", "n")
    return map_counts(tok, kinds).groupBy("doc_id").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, entry))).alias(k)
        for k in kinds])


def distinct_words(tok: DataFrame) -> DataFrame:
    """`doc_id, types, avg_types_per_sentence` by nested keyed aggregations."""
    return (tok.groupBy("doc_id", "sentence_id", F.lower("token").alias("low")).agg(F.lit(1).alias("one"))
            .groupBy("doc_id", "low").agg(F.count("*").alias("k"))
            .groupBy("doc_id").agg(F.count("*").alias("types"), F.sum("k").alias("in_sentences")))


def head_profiles(tok: DataFrame, stative: list[str] = (), ambiguous: list[str] = ()) -> DataFrame:
    """What each token is and which children it has: `doc_id, node, ...`.

    A token sends one row to itself and one to its head, and one aggregation on
    `(doc_id, node)` joins both: no self-join, and no group larger than a head's children.
    Only verbs, copulas and listed verbs, and children with a counted relation, send rows.
    """
    low = F.lower("lemma")
    in_chunk = F.col("dep").isin(fv.VERB_CHUNK_DEPS)
    none = F.lit(False)
    own = F.struct(
        F.col("token_id").alias("node"), (F.col("pos") == "VERB").alias("verb"),
        (F.col("lemma") == "be").alias("be"),
        low.isin(list(stative)).alias("stative"), low.isin(list(ambiguous)).alias("ambiguous"),
        in_chunk.cast("int").alias("chunk"), none.alias("copula"), none.alias("object"),
        none.alias("person"))
    to_head = F.struct(
        F.col("head_token_id").alias("node"), none.alias("verb"), none.alias("be"),
        none.alias("stative"), none.alias("ambiguous"), in_chunk.cast("int").alias("chunk"),
        F.col("dep").isin(fv.COPULA_DEPS).alias("copula"), (F.col("dep") == "dobj").alias("object"),
        ((F.col("dep") == "nsubj") & ((F.col("tag") == "PRP") | (F.col("ent_type") == "PERSON")))
        .alias("person"))
    is_child = F.col("head_token_id") != F.col("token_id")
    looked_at = ((F.col("pos") == "VERB") | (F.col("lemma") == "be")
                 | low.isin([*stative, *ambiguous]))
    rows = F.array(F.when(looked_at, own), F.when(is_child & in_chunk, to_head))
    return (tok.select("doc_id", F.explode(rows).alias("e"))
            .where(F.col("e").isNotNull()).select("doc_id", "e.*")
            .groupBy("doc_id", "node")
            .agg(*[F.bool_or(c).alias(c) for c in
                   ("verb", "be", "stative", "ambiguous", "copula", "object", "person")],
                 F.sum("chunk").alias("chunk")))


def tree_counters(tok: DataFrame, stative: list[str] = (), ambiguous: list[str] = ()) -> DataFrame:
    """Verb chunk length, copulas and stative verbs.

    An ambiguous stative verb with both an object and a personal subject does not count.
    """
    transitive = F.col("object") & F.col("person")
    verbs = F.count_if("verb")
    return head_profiles(tok, stative, ambiguous).groupBy("doc_id").agg(
        F.when(verbs > 0, F.sum(F.when(F.col("verb"), F.col("chunk"))) / verbs)
        .otherwise(0.0).alias("avg_verb_chunk_length"),
        F.count_if(F.col("be") & F.col("copula")).alias("copula_verbs"),
        F.count_if(F.col("stative") | (F.col("ambiguous") & ~transitive)).alias("stative_verbs"))


def split_stative(lines: list[str]) -> tuple[list[str], list[str]]:
    """Stative verb list with `(amb)` marks to plain and ambiguous verbs."""
    plain, ambiguous = [], []
    for line in filter(None, (x.strip() for x in lines)):
        marked = "(amb)" in line
        (ambiguous if marked else plain).append(line.replace("(amb)", "").strip())
    return plain, ambiguous


def document_counters(tok: DataFrame, names: list[str] | None = None, *,
                      noun_chunks: DataFrame | None = None, suasive: list[str] = (),
                      stative: list[str] = (), ambiguous: list[str] = (),
                      normalize: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """`doc_id` and one column per known name; unknown names are skipped.

    Transition counters count sentence-initial transitions. `noun_chunks` is a span table.
    With `normalize`, averages and dictionaries stay, `sent_*` are per sentence and the rest
    per token. `docs` keeps documents without tokens, as zeros.
    """
    names = [n for n in (names or ALL) if n in ALL]
    plain = _plain() | {"suasive_verbs": F.count_if(F.lower("lemma").isin(list(suasive)))}
    basis = {n: plain[n] for n in names if n in plain}
    basis |= {"_n": F.count("*"), "_s": F.count_if(F.col("sent_pos") == 0)}
    out = tok.groupBy("doc_id").agg(*[c.alias(n) for n, c in basis.items()])
    if set(names) & set(DISTINCT):
        out = out.join(distinct_words(tok), "doc_id", "left").withColumn(
            "avg_types_per_sentence", F.col("in_sentences") / F.col("_s"))
    if set(names) & set(TREE):
        out = out.join(tree_counters(tok, stative, ambiguous), "doc_id", "left")
    if set(names) & set(OPENING):
        found = style.transition_matches(tok).groupBy("doc_id").agg(
            F.count("*").alias("transition_words"),
            F.count_distinct("transition").alias("unique_transitions"))
        out = out.join(found, "doc_id", "left")
    if kinds := [n for n in names if n in MAPS]:
        out = out.join(_maps(tok, kinds), "doc_id", "left")
    if "avg_noun_chunk_length" in names:
        if noun_chunks is None:
            out = out.withColumn("avg_noun_chunk_length", F.lit(0.0))
        else:
            length = F.avg(F.col("end") - F.col("start")).alias("avg_noun_chunk_length")
            out = out.join(noun_chunks.groupBy("doc_id").agg(length), "doc_id", "left")
    if docs is not None:
        out = docs.select("doc_id").join(out, "doc_id", "left")
    return out.select("doc_id", *[_finished(n, normalize) for n in names])


def _finished(name: str, normalize: bool) -> Column:
    value = F.col(name)
    if name in MAPS:
        return value
    zero = F.lit(0.0) if name.startswith("avg_") else F.lit(0).cast(LONG)
    filled = F.coalesce(value, zero)
    if not normalize or name.startswith("avg_"):
        return filled.alias(name)
    per = F.col("_s") if name.startswith("sent_") else F.col("_n")
    return F.coalesce(F.try_divide(filled, per), F.lit(0.0)).alias(name)


def punctuation_count(kind: str | None = None) -> Column:
    """Aggregate that counts punctuation tokens, all or of one named kind."""
    if kind is None:
        return F.count_if("is_punct")
    if kind not in fv.PUNCT_TYPES:
        raise ValueError(f"unknown punctuation type: {kind}")
    return F.count_if(F.col("is_punct") & (F.col("token") == fv.PUNCT_TYPES[kind]))
