"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histograms of character classes and of common words are compared with those of its
language by the Jensen-Shannon distance. The references are the sums over all documents of a
language; the common words are fixed lists. A histogram is only judged where it has enough counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloweave.llm.storage import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
# fixed values: frequent closed-class words of each language
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "was", "be", "by", "this"),
    "fr": ("de", "la", "le", "les", "et", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"),
}
#: Characters and words under which a histogram is not judged, and the largest distances of documents that stay.
MIN_CHARS, MIN_COUNTED = 200, 50
#: The word limit grows by a multiple of 1 / sqrt(words), the noise of a short text's histogram.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, WORD_NOISE = 0.28, 0.22, 1.0
MIN_WORDS = 50


def let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    def covered(windows: Column) -> Column:
        """Windows sorted with their places; neighbours of equal text are repeats."""
        def places(ordered: Column) -> Column:
            n = F.size(ordered)
            flagged = F.filter(ordered, lambda x, i: (
                ((i > 0) & (F.get(ordered, i - 1)["w"] == x["w"]))
                | ((i < n - 1) & (F.get(ordered, i + 1)["w"] == x["w"]))))
            return F.size(F.array_distinct(F.flatten(F.transform(
                flagged, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
        repeated = let(F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), places)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(repeated)

    def of(ws: Column) -> Column:
        starts = F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0)))
        return let(F.transform(starts, lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1), F.get(ws, i + 2))), covered)
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(of(words)).cast("long")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Counts of each row; `chars` and `common` (listed words, then all others) are its two
    histograms."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text"))) \
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    every = sorted({w for words in COMMON.values() for w in words})
    lists = {lang: F.array(*map(F.lit, words)) for lang, words in COMMON.items()}
    own = F.lit(None).cast("array<string>")
    for lang, words in lists.items():
        own = F.when(F.col("lang") == lang, words).otherwise(own)
    own = F.coalesce(own, F.array(*map(F.lit, every)))
    lower = F.transform(F.filter("words", lambda w: F.length(w) <= 6), lambda w: F.lower(w))
    found = let(own, lambda listed: F.filter(lower, lambda w: F.array_contains(listed, w)))
    listed_counts = let(found, lambda have: F.concat(let(own, lambda listed: F.transform(
        listed, lambda c: (F.size(have) - F.size(F.array_remove(have, c))).cast("double"))),
        F.array((F.size("words") - F.size(have)).cast("double"))))
    text = F.col("text")
    counts = rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length("text").alias("n_chars"),
        _count(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"), listed_counts.alias("common"),
        _count(text, "[a-z]+").alias("c_lower"), _count(text, r"\p{Lu}+").alias("c_upper"),
        _count(text, "[0-9]+").alias("c_digit"), _count(text, "[.,;:!?'\"()-]+").alias("c_mark"))
    space = F.col("n_chars") - F.col("word_chars")
    classes = [space, F.col("c_lower"), F.col("c_upper"), F.col("c_digit"), F.col("c_mark"), F.col("n_symbols")]
    rest = F.col("n_chars")
    for c in classes:
        rest = rest - c
    return counts.withColumn("chars", F.array(*[c.cast("double") for c in [*classes, rest]])) \
        .select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "chars", "common")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def js_distance(counts: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance (base 2, from 0 to 1) of two histograms of equal length."""
    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def of(a: Column, b: Column) -> Column:
        terms = F.zip_with(counts, reference, lambda x, y: let(
            F.struct((x / a).alias("p"), (y / b).alias("q")),
            lambda s: part(s["p"], (s["p"] + s["q"]) / 2) + part(s["q"], (s["p"] + s["q"]) / 2)))
        return F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0)))
    return F.when((total(counts) > 0) & (total(reference) > 0),
                  let(total(counts), lambda a: let(total(reference), lambda b: of(a, b))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_char_distance: float = MAX_CHAR_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
          word_noise: float = WORD_NOISE) -> DataFrame:
    """One row per row of `docs`: the counts of the base rules, both distances, base_failed, kept.

    Null and empty texts have no words, so the base rules fail. A null or unlisted language is
    compared with the documents of the same value, by the words of all lists. A histogram with
    fewer counts than its guard passes. Null ids stay null, repeated rows are judged each, other
    columns are not carried.
    """
    rows = stored(features(docs, id_col, text_col, lang_col))
    def summed(name: str, size: int) -> Column:
        return F.array(*[F.sum(F.coalesce(F.get(name, F.lit(i)), F.lit(0.0))) for i in range(size)])
    width = len({w for words in COMMON.values() for w in words}) + 1
    reference = rows.groupBy("lang").agg(summed("chars", 7).alias("ref_chars"),
                                         summed("common", width).alias("ref_common"))
    judged = rows.join(reference, "lang") \
        .withColumn("ref_common", F.slice("ref_common", F.lit(1), F.size("common"))) \
        .withColumn("char_distance", js_distance(F.col("chars"), F.col("ref_chars"))) \
        .withColumn("word_distance", js_distance(F.col("common"), F.col("ref_common"))) \
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                    | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    far = ((total(F.col("chars")) >= MIN_CHARS) & (F.col("char_distance") > max_char_distance)) \
        | ((total(F.col("common")) >= MIN_COUNTED) & (F.col("word_distance") > F.lit(max_word_distance) + F.lit(word_noise) / F.sqrt("n_words")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "char_distance", "word_distance", "base_failed",
                         (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))
