"""Token tables: from raw text, from an annotation table, and a fixture annotator.

The token table is the central relation. One row per token:

    doc_id, sentence_id, token_id, sent_pos, token, lemma, pos, tag, morph, head_token_id,
    dep, is_punct, is_stop, ent_type, ent_start, next_pos, prev_pos

`token_id` is the position in the document, `sent_pos` the position in the sentence, and a
root is its own head. `next_pos`/`prev_pos` stay within the sentence, so the feature jobs
need no window of their own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from styloweave.functions import text as tx
from styloweave.operators import syntax

ANNOTATION_COLUMNS = ["doc_id", "sentence_id", "token_id", "token", "lemma", "pos", "tag",
                      "head_token_id", "dep"]
SENTENCE_KEY = ["doc_id", "sentence_id"]


# ------------------------------------------------------------------------- raw text
def _sentences(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per document with the words of each sentence as an array of arrays."""
    return docs.select(
        "doc_id", *keep,
        F.transform(tx.sentences_of(F.col("text")), tx.words_of).alias("sents"))


def _exploded(items: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Token rows of the `items` column; the position in the array is the token id.

    The outer explode keeps the optimizer from adding a filter on the array size, which
    would tokenise a second time. Only the items pass the explode, never an array that would
    be copied into every token row.
    """
    return (items.select("doc_id", *keep, F.posexplode_outer("items").alias("token_id", "i"))
            .where(F.col("i").isNotNull())
            .select("doc_id", *keep, "token_id", "i.*"))


def tokenize(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Raw text to `doc_id, token_id, sentence_id, sent_pos, token, is_last`, without a shuffle."""
    numbered = F.transform("sents", lambda s, i: F.transform(s, lambda w, j: F.struct(
        i.alias("sentence_id"), j.alias("sent_pos"), w.alias("token"),
        (j == F.size(s) - 1).alias("is_last"))))
    return _exploded(_sentences(docs, keep).select("doc_id", *keep,
                                                   F.flatten(numbered).alias("items")), keep)


def by_repetition(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id occurs once, and the others, or None if there are none.

    The first part's tokens stay with their document when nothing has moved them, which spares the shuffle that
    tokens of repeated ids need to meet. One pass over the ids decides.
    """
    repeated = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    if repeated.isEmpty():
        return docs, None
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    return docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")


def token_arrays(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per document with all its tokens in order."""
    return docs.select("doc_id", *keep, tx.words_of(F.col("text")).alias("tokens"))


# ------------------------------------------------------------------------- annotations
def from_annotations(df: DataFrame, mapping: dict[str, str] | None = None,
                     per_sentence_ids: bool = False) -> DataFrame:
    """Accept a token annotation table.

    `mapping` names the input column of each field. Missing optional fields get neutral
    values. With `per_sentence_ids`, token and head ids restart in each sentence and are
    renumbered over the document.

    One shuffle, on the sentence key: a document that holds a large share of the rows is
    still spread over many tasks.
    """
    mapping = mapping or {}
    renamed = df.withColumnsRenamed({v: k for k, v in mapping.items() if v in df.columns})
    missing = [c for c in ANNOTATION_COLUMNS if c not in renamed.columns]
    if missing:
        raise ValueError(f"annotation table lacks {missing}; name them in `mapping`")

    have = set(renamed.columns)
    def optional(name: str, default: Column) -> Column:
        return (F.col(name) if name in have else default).alias(name)

    base = renamed.select(
        "doc_id", F.col("sentence_id").cast("int"), F.col("token_id").cast("int"), "token",
        "lemma", "pos", "tag", F.col("head_token_id").cast("int"), "dep",
        optional("morph", F.lit("")),
        optional("is_punct", F.col("pos") == "PUNCT"),
        optional("is_stop", F.lit(False)),
        optional("ent_type", F.lit("")),
        optional("ent_iob", F.lit(None).cast("string")),
    )
    if per_sentence_ids:
        base = _document_positions(base)
    in_order = W.partitionBy(*SENTENCE_KEY).orderBy("token_id")
    previous = F.lag("ent_type").over(in_order)
    starts = F.when(F.col("ent_iob").isNotNull(), F.col("ent_iob") == "B").otherwise(
        (F.col("ent_type") != "") & ~previous.eqNullSafe(F.col("ent_type")))
    return base.select(
        "*",
        (F.row_number().over(in_order) - 1).alias("sent_pos"),
        F.lead("pos").over(in_order).alias("next_pos"),
        F.lag("pos").over(in_order).alias("prev_pos"),
        starts.alias("ent_start"),
    ).drop("ent_iob")


def _document_positions(tok: DataFrame, block: int = 4096) -> DataFrame:
    """Renumber tokens over the document: the length of all earlier sentences is added.

    The running sum takes two levels, over blocks of sentences and inside each block, so no
    task holds all sentences of a huge document.
    """
    lengths = tok.groupBy(*SENTENCE_KEY).agg(
        F.min("token_id").alias("_first"), F.count("*").alias("_len")) \
        .withColumn("_block", F.floor(F.col("sentence_id") / block))
    def earlier(*keys):
        return W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    blocks = lengths.groupBy("doc_id", "_block").agg(F.sum("_len").alias("_sum")).select(
        "doc_id", "_block",
        F.coalesce(F.sum("_sum").over(earlier("doc_id", "_block")), zero).alias("_before"))
    inside = F.coalesce(F.sum("_len").over(earlier("doc_id", "_block", "sentence_id")), zero)
    shift = lengths.withColumn("_inside", inside).join(blocks, ["doc_id", "_block"]).select(
        *SENTENCE_KEY, (F.col("_before") + F.col("_inside") - F.col("_first")).alias("_shift"))
    return (tok.join(shift, SENTENCE_KEY)
            .withColumn("token_id", (F.col("token_id") + F.col("_shift")).cast("int"))
            .withColumn("head_token_id", (F.col("head_token_id") + F.col("_shift")).cast("int"))
            .drop("_shift"))


def invalid_heads(tok: DataFrame) -> DataFrame:
    """Tokens whose head is not a token of their sentence, and sentences without one root.

    Returns `doc_id, sentence_id, problem, n`. Run before the tree operators on
    annotations of unknown origin.
    """
    nodes = tok.select(*SENTENCE_KEY, F.col("token_id").alias("head_token_id"),
                       F.lit(1).alias("_found"))
    stray = (tok.select(*SENTENCE_KEY, "head_token_id")
             .join(nodes, SENTENCE_KEY + ["head_token_id"], "left_anti")
             .groupBy(*SENTENCE_KEY).agg(F.count("*").alias("n"))
             .select(*SENTENCE_KEY, F.lit("head outside sentence").alias("problem"), "n"))
    roots = (tok.groupBy(*SENTENCE_KEY)
             .agg(F.count_if(F.col("head_token_id") == F.col("token_id")).alias("n"))
             .where("n <> 1")
             .select(*SENTENCE_KEY, F.lit("not one root").alias("problem"), "n"))
    return stray.unionByName(roots)


def save_bucketed(tok: DataFrame, table: str, buckets: int) -> None:
    """Store a token table bucketed by document.

    Later aggregations keyed by the document, alone or with other keys, then need no
    shuffle. Use plain parquet if single documents hold a large share of the rows.
    """
    (tok.write.mode("overwrite").bucketBy(buckets, "doc_id")
     .sortBy("doc_id", "token_id").saveAsTable(table))


def children_of(tok: DataFrame) -> DataFrame:
    """`doc_id, token_id, children`: child ids of each head in token order."""
    return (tok.where(F.col("head_token_id") != F.col("token_id"))
            .select("doc_id", F.col("head_token_id").alias("token_id"),
                    F.col("token_id").alias("child"))
            .groupBy("doc_id", "token_id")
            .agg(F.sort_array(F.collect_list("child")).alias("children")))


# ------------------------------------------------------------------------- fixture annotator
# Fixed values of the fixture annotator: closed classes, suffixes and tags.
CLOSED_CLASSES = [
    ("DET", "the a an this that"), ("CCONJ", "and or but"),
    ("ADP", "of in on at to for with by from"),
    ("PRON", "i you he she it we they who which what"),
    ("AUX", "is are was were be been"), ("SCONJ", "if because"), ("PART", "not"),
]
SUFFIX_CLASSES = [("ADV", "ly"), ("VERB", "ing"), ("VERB", "ed"), ("ADJ", "able"),
                  ("ADJ", "ish")]
STOP_CLASSES = [pos for pos, _ in CLOSED_CLASSES]
TAG_OF_POS = {"PUNCT": ".", "NUM": "CD", "DET": "DT", "CCONJ": "CC", "ADP": "IN",
              "SCONJ": "IN", "PART": "RB", "PROPN": "NNP", "ADV": "RB", "ADJ": "JJ",
              "NOUN": "NN"}
DEP_OF_POS = {"PUNCT": "punct", "DET": "det", "CCONJ": "cc", "ADP": "prep", "PRON": "nsubj",
              "ADJ": "amod", "ADV": "advmod", "PART": "neg", "SCONJ": "mark", "NUM": "nummod"}
NOUN_DEP_AFTER = {"VERB": "dobj", "AUX": "attr", "ADP": "pobj"}


POS_NAMES = ["PUNCT", "NUM", "PROPN", "ADV", "VERB", "ADJ", "NOUN", "AUX", "DET", "CCONJ", "ADP", "PRON", "SCONJ", "PART"]
POS_CODE = {name: n for n, name in enumerate(POS_NAMES)}
FIXTURE_COLUMNS = {
    "sentence_id": "int", "token_id": "int", "sent_pos": "int", "token": "string", "lemma": "string", "pos": "string",
    "tag": "string", "morph": "string", "head_token_id": "int", "dep": "string", "is_punct": "boolean",
    "is_stop": "boolean", "ent_type": "string", "ent_start": "boolean", "next_pos": "string", "prev_pos": "string"}


class _Coded:
    """Strings of a column as places in a short list of distinct ones."""

    def __init__(self, names: list[str]):
        self.names = list(dict.fromkeys(names))
        self.at = {name: n for n, name in enumerate(self.names)}

    def spelled(self, codes: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(codes, pa.int32(), mask=absent))


_POS = _Coded(POS_NAMES)
_TAGS = _Coded(["WP", "WDT", "PRP", "VBZ", "VBP", "VBG", "VBD", *TAG_OF_POS.values()])
_MORPHS = _Coded(["", "VerbForm=Ger", "Tense=Past|VerbForm=Fin", "Number=Sing", "PunctType=Peri"])
_DEPS = _Coded(["ROOT", "auxpass", "aux", "relcl", "conj", "compound", "dep", *NOUN_DEP_AFTER.values(), *DEP_OF_POS.values()])
_ENTITIES = _Coded(["", "PERSON", "DATE"])


def _lowered(words: pa.Array) -> pa.Array:
    """Lower-cased with the full mappings of Unicode."""
    low, others = pc.ascii_lower(words), pc.invert(pc.string_is_ascii(words))
    if not pc.any(others).as_py():
        return low
    return pc.replace_with_mask(low, others, pa.array([w.lower() for w in words.filter(others).to_pylist()], pa.string()))


class _Words:
    """What the fixture tells of distinct words, whatever their place."""

    def __init__(self, words: pa.Array):
        self.low = low = _lowered(words)
        texts, n = words, len(words)
        first = pc.utf8_slice_codeunits(texts, 0, 1)
        ascii_first = pc.string_is_ascii(first).to_numpy(zero_copy_only=False)
        capital = pc.match_substring_regex(first, "^[A-Z]").to_numpy(zero_copy_only=False)
        word = (pc.greater(pc.utf8_length(texts), 1).to_numpy(zero_copy_only=False)
                | pc.match_substring_regex(texts, "^[a-zA-Z0-9]").to_numpy(zero_copy_only=False))
        capital, word = capital.copy(), word.copy()
        others = np.flatnonzero(~ascii_first)
        kinds = [unicodedata.category(c) for c in first.take(pa.array(others)).to_pylist()]
        capital[others] = [k == "Lu" for k in kinds]
        word[others] |= np.array([k[0] in "LN" for k in kinds], bool)

        def ends(ending: str) -> np.ndarray:
            return pc.ends_with(low, ending).to_numpy(zero_copy_only=False)

        closed = {w: name for name, words in CLOSED_CLASSES for w in words.split()}
        known = pc.index_in(low, value_set=pa.array(list(closed))).fill_null(-1).to_numpy(zero_copy_only=False)
        number = pc.match_substring_regex(texts, "^[0-9]+$").to_numpy(zero_copy_only=False)
        pos = np.full(n, POS_CODE["NOUN"], np.int32)
        for name, ending in reversed(SUFFIX_CLASSES):
            pos[ends(ending)] = POS_CODE[name]
        of_closed = np.array([POS_CODE[name] for name in closed.values()], np.int32)
        pos[known >= 0] = of_closed[known[known >= 0]]
        pos[number] = POS_CODE["NUM"]
        pos[~word] = POS_CODE["PUNCT"]
        self.word, self.pos = word, pos
        self.named = capital & word & ~number & (known < 0)     # proper nouns inside a sentence

        def equals(*values: str) -> np.ndarray:
            return pc.is_in(low, value_set=pa.array(values)).to_numpy(zero_copy_only=False)

        self.ing, self.ed, self.relative = ends("ing"), ends("ed"), equals("who", "which")
        tags = np.array([_TAGS.at[TAG_OF_POS.get(name, {"PRON": "PRP", "AUX": "VBP", "VERB": "VBD"}.get(name))]
                         for name in POS_NAMES], np.int32)
        self.tag = tags[pos]
        self.tag[(pos == POS_CODE["VERB"]) & self.ing] = _TAGS.at["VBG"]
        for tag, of in (("VBZ", ("is",)), ("WDT", ("which",)), ("WP", ("who", "what"))):
            self.tag[equals(*of)] = _TAGS.at[tag]
        self.morph = np.zeros(n, np.int32)
        self.morph[pc.is_in(texts, value_set=pa.array([".", "!", "?"])).to_numpy(zero_copy_only=False)] = _MORPHS.at["PunctType=Peri"]
        self.morph[pos == POS_CODE["NOUN"]] = _MORPHS.at["Number=Sing"]
        verb = pos == POS_CODE["VERB"]
        self.morph[verb] = np.where(self.ing[verb], _MORPHS.at["VerbForm=Ger"], _MORPHS.at["Tense=Past|VerbForm=Fin"])


class Annotated:
    """Columns of the tokens of a batch of sentences, each worked out when it is asked for.

    A part of speech is told from the distinct words of the batch, the rest from neighbours in the sentence.
    """

    def __init__(self, words: pa.Array):
        bounds = words.offsets.to_numpy().astype(np.int64)
        self.sizes = np.diff(bounds)
        self.first = bounds[:-1] - bounds[0]
        self.token = words.flatten()
        n = len(self.token)
        self.sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.here = np.arange(n)
        self.sent_pos = self.here - self.first[self.sentence]
        coded = self.token.dictionary_encode()
        self.token_names = coded.dictionary
        self.code, self.words = coded.indices.to_numpy(), _Words(coded.dictionary)
        starts = self.sent_pos == 0
        self.starts, self.ends = starts, np.append(starts[1:], True)[:n]
        self.pos = np.where(~starts & self.words.named[self.code], POS_CODE["PROPN"], self.words.pos[self.code])

    def is_(self, *names: str) -> np.ndarray:
        wanted = np.zeros(len(POS_NAMES), bool)
        wanted[[POS_CODE[name] for name in names]] = True
        return wanted[self.pos]

    def low(self) -> pa.Array:
        return self.words.low.take(pa.array(self.code))

    def back(self) -> np.ndarray:
        """Steps to the head: a mark's is the first of its run, a word and the marks after it, a word's that of the run before."""
        begins = self.starts | self.words.word[self.code]
        run = np.maximum.accumulate(np.where(begins, self.here, 0)) if len(self.here) else self.here
        before = np.concatenate((run[:1], run[:-1]))
        return np.where(begins, np.where(self.starts, 0, self.here - before), self.here - run)

    def dep_codes(self) -> np.ndarray:
        plain = np.array([_DEPS.at[DEP_OF_POS.get(name, "dep")] for name in POS_NAMES], np.int32)
        after = np.full(len(POS_NAMES), _DEPS.at["compound"], np.int32)
        for name, dep in NOUN_DEP_AFTER.items():
            after[POS_CODE[name]] = _DEPS.at[dep]
        earlier, later = np.concatenate((self.pos[:1], self.pos[:-1])), np.append(self.pos[1:], self.pos[-1:])
        own, before, behind = self.code, np.concatenate((self.code[:1], self.code[:-1])), np.append(self.code[1:], self.code[-1:])
        passive = ~self.ends & (later == POS_CODE["VERB"]) & self.words.ed[behind]
        out = plain[self.pos]
        out = np.where(self.is_("PROPN", "NOUN"), after[earlier], out)
        out = np.where(self.is_("VERB"), np.where(self.words.relative[before], _DEPS.at["relcl"], _DEPS.at["conj"]), out)
        out = np.where(self.is_("AUX"), np.where(passive, _DEPS.at["auxpass"], _DEPS.at["aux"]), out)
        return np.where(self.starts, _DEPS.at["ROOT"], out).astype(np.int32)

    def tag_codes(self) -> np.ndarray:
        return np.where(self.is_("PROPN"), _TAGS.at["NNP"], self.words.tag[self.code])

    def morph_codes(self) -> np.ndarray:
        return np.where(self.is_("PROPN"), _MORPHS.at["Number=Sing"], self.words.morph[self.code])

    def entity_codes(self) -> np.ndarray:
        return np.where(self.is_("PROPN"), 1, np.where(self.is_("NUM"), 2, 0))

    def column(self, name: str) -> pa.Array:
        """A column that is told from the sentence alone."""
        if name == "token":
            return self.token
        if name == "sent_pos":
            return pa.array(self.sent_pos, pa.int32())
        if name == "lemma":
            return pc.if_else(pa.array(self.is_("AUX")), "be", self.low())
        if name == "pos":
            return _POS.spelled(self.pos)
        if name == "prev_pos":
            return _POS.spelled(np.concatenate((self.pos[:1], self.pos[:-1])), self.starts)
        if name == "next_pos":
            return _POS.spelled(np.append(self.pos[1:], self.pos[-1:]), self.ends)
        if name == "tag":
            return _TAGS.spelled(self.tag_codes())
        if name == "morph":
            return _MORPHS.spelled(self.morph_codes())
        if name == "dep":
            return _DEPS.spelled(self.dep_codes())
        if name == "is_punct":
            return pa.array(self.is_("PUNCT"))
        if name == "is_stop":
            return pa.array(self.is_(*STOP_CLASSES))
        if name == "ent_type":
            return _ENTITIES.spelled(self.entity_codes())
        if name == "ent_start":
            return pa.array(self.is_("PROPN", "NUM"))
        raise KeyError(name)


def sentence_words(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """`doc_id, sentence_id, words`: sentences in order, those of a document one after the other."""
    return (_sentences(docs, keep).select("doc_id", *keep, F.posexplode_outer("sents").alias("sentence_id", "words"))
            .where(F.col("words").isNotNull()))


def annotate_fixture(docs: DataFrame, keep: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """A small deterministic annotator for tests and benches; no claim to be a parser.

    Closed classes and suffixes give the part of speech; the head is the nearest earlier
    word. Whole batches of sentences are annotated at once, without a shuffle. `columns` names those wanted, all by
    default.
    """
    wanted = [c for c in FIXTURE_COLUMNS if columns is None or c in columns]
    given = ["doc_id", *keep]

    def annotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0      # tokens of the document that the last batch ended in
        for batch in batches:
            words = batch.column(batch.num_columns - 1)
            number = batch.column(batch.num_columns - 2).to_numpy()
            own = Annotated(words)
            total = np.concatenate(([0], np.cumsum(own.sizes)))
            begins = np.maximum.accumulate(np.where(number == 0, np.arange(len(number)), -1))
            earlier = np.where(begins >= 0, total[begins], -held)
            held = int(total[-1] - earlier[-1]) if len(number) else held
            token_id = own.here - earlier[own.sentence]
            made = {"token_id": token_id, "sentence_id": number[own.sentence]}
            if "head_token_id" in wanted:
                made["head_token_id"] = token_id - own.back()
            rows = pa.array(own.sentence)
            out = [batch.column(n).take(rows) for n in range(len(given))]
            out += [pa.array(made[c], pa.int32()) if c in made else own.column(c) for c in wanted]
            yield pa.RecordBatch.from_arrays(out, names=[*given, *wanted])

    sentences = sentence_words(docs, keep)
    schema = T.StructType([sentences.schema[c] for c in given]
                          + [T.StructField(c, T._parse_datatype_string(FIXTURE_COLUMNS[c])) for c in wanted])
    return sentences.mapInArrow(annotated, schema)


def annotated_trees(docs: DataFrame) -> DataFrame:
    """`syntax.linear_trees` of the fixture's annotation, made where sentences are annotated; ids must not repeat."""
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(2)
            some = pa.array(np.flatnonzero(np.diff(words.offsets.to_numpy()) > 0))
            words = words.take(some)
            own = Annotated(words)

            def gathered(values: pa.Array, words=words) -> pa.Array:
                return pa.ListArray.from_arrays(pc.subtract(words.offsets, words.offsets[0]), values)
            label = pc.binary_join_element_wise(*[own.column(c) for c in ("token", "lemma", "tag", "dep")], "-")
            heads = pa.array((own.sent_pos - own.back()).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(some), batch.column(1).take(some), pc.binary_join(words, " "),
                 syntax.preorder_trees(gathered(heads), gathered(label))], names=["doc_id", "sentence_id", "sentence", "tree"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return sentence_words(docs).mapInArrow(trees, f"doc_id {kind}, sentence_id int, sentence string, tree string")


def fixture_noun_chunks(tok: DataFrame) -> DataFrame:
    """Noun chunks of the fixture: a noun with a determiner right before it.

    A span table `doc_id, kind, start, end, label`; `end` is exclusive.
    """
    return (tok.where(F.col("pos").isin("NOUN", "PROPN"))
            .select("doc_id", F.lit("noun_chunk").alias("kind"),
                    (F.col("token_id") - F.coalesce((F.col("prev_pos") == "DET").cast("int"),
                                                    F.lit(0))).alias("start"),
                    (F.col("token_id") + 1).alias("end"), F.lit("NP").alias("label")))


def entity_spans(tok: DataFrame) -> DataFrame:
    """Entity spans of a token table: one row per entity start, with its length."""
    ordinal = F.sum(F.col("ent_start").cast("int")).over(
        W.partitionBy(*SENTENCE_KEY).orderBy("token_id"))
    return (tok.select(*SENTENCE_KEY, "token_id", "ent_type", ordinal.alias("_ent"))
            .where(F.col("ent_type") != "")
            .groupBy(*SENTENCE_KEY, "_ent")
            .agg(F.min("token_id").alias("start"), (F.max("token_id") + 1).alias("end"),
                 F.min_by("ent_type", "token_id").alias("label"))
            .select("doc_id", F.lit("ent").alias("kind"), "start", "end", "label"))
