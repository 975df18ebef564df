"""Column expressions over raw text: sentences, words, spacing, emoji, syllables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's and RE2's classes differ on whitespace, so it is spelled out.
WS = r" \t\n\r\f\x0B"
# A run of letters and digits with an optional 'suffix, or any other visible character. The
# ASCII ranges are part of the classes; named first they spare most class look-ups.
WORD = rf"[a-zA-Z0-9\p{{L}}\p{{N}}]+(?:'[a-zA-Z\p{{L}}]+)?|[^{WS}]"
# A sentence runs up to and with a group of terminators. One character class follows the
# terminator instead of a repeated group, so the match needs no stack on long dotted lines.
SENTENCE = rf"[^.!?]*[.!?][.!?{WS}]*|[^.!?]+"

# Code point ranges of pictographs, with modifiers, joiners, flags and keycaps. A joined
# sequence is one emoji, so a skin-toned thumb does not count as the plain one.
_PICTO = (
    r"\x{1F300}-\x{1F3FA}\x{1F400}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}"
    r"\x{1F7E0}-\x{1F7F0}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}"
    r"\x{231A}-\x{231B}\x{23E9}-\x{23F3}\x{25FD}-\x{25FE}\x{2600}-\x{27BF}"
    r"\x{2B50}\x{2B55}\x{2B1B}-\x{2B1C}"
)
_MODIFIER = r"[\x{1F3FB}-\x{1F3FF}\x{FE0F}]"
_ONE = rf"[{_PICTO}]{_MODIFIER}?"
EMOJI = (
    rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}"
    rf"|[0-9#*]\x{{FE0F}}?\x{{20E3}}"
    rf"|{_ONE}(?:\x{{200D}}{_ONE})*"
)

# Every emoji has a character from the keycap on; the plain range spares most texts the search.
EMOJI_NEEDS = r"[\x{20E3}-\x{10FFFF}]"

# Tokens that can be a part of an emoji sequence.
EMOJI_PART = rf"[{_PICTO}\x{{1F1E6}}-\x{{1F1FF}}\x{{1F3FB}}-\x{{1F3FF}}\x{{FE0F}}\x{{200D}}\x{{20E3}}]"


def sentences_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def emojis_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMOJI), F.lit(0))


def text_length(text: Column) -> Column:
    return F.length(text).cast("long")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank text."""
    return F.regexp_count(text, F.lit(rf"[^{WS}]+")).cast("long")


def repair_spacing(text: Column) -> Column:
    """Attach punctuation and brackets to their words, then collapse and strip spaces.

    `(?U)` makes `\\s` cover Unicode spaces.
    """
    closed_up = F.regexp_replace(text, r"(?U)\s+([,.;:!?%])", "$1")
    opened = F.regexp_replace(closed_up, r"(?U)\(\s+", "(")
    bracketed = F.regexp_replace(opened, r"(?U)\s+\)", ")")
    collapsed = F.regexp_replace(bracketed, r"(?U)\s{2,}", " ")
    return F.regexp_replace(collapsed, r"(?U)^\s+|\s+$", "")


def is_alphabetic(ch: Column) -> Column:
    return ch.rlike(r"^\p{L}$")


def syllables(word: Column) -> Column:
    """Vowel groups of a word, at least one."""
    groups = F.regexp_count(F.lower(word), F.lit("[aeiouyáéíóúàèìòùäöüâêîôûë]+"))
    return F.greatest(groups, F.lit(1)).cast("long")
