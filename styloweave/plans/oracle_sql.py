"""Common table expressions of the check queries: tokens and fixture annotations in SQL."""

from __future__ import annotations

from styloweave.functions import text as tx
from styloweave.operators import tokens as tk


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def values_table(rows) -> str:
    """Rows of strings and numbers as a VALUES list."""
    def cell(v):
        return q(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def tokens_cte(source: str = "SELECT doc_id, text FROM documents") -> str:
    """`tok(doc_id, sentence_id, sent_pos, token, token_id)`."""
    sent, word = q(tx.SENTENCE), q(tx.WORD)
    return f"""
src AS ({source}),
sents AS (SELECT doc_id, unnest(regexp_extract_all(text, {sent})) AS sent,
                 generate_subscripts(regexp_extract_all(text, {sent}), 1) - 1 AS sentence_id
          FROM src),
words AS (SELECT doc_id, sentence_id, regexp_extract_all(sent, {word}) AS w FROM sents),
tok0 AS (SELECT doc_id, sentence_id, unnest(w) AS token,
                generate_subscripts(w, 1) - 1 AS sent_pos FROM words),
tok AS (SELECT *, lower(token) AS low,
               row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id, sent_pos) - 1 AS token_id
        FROM tok0)"""


def annotated_cte(source: str = "SELECT doc_id, text FROM documents") -> str:
    """`ann`: the tokens with the fixture annotation."""
    closed = "\n".join(f"WHEN low IN {in_list(w.split())} THEN '{name}'"
                       for name, w in tk.CLOSED_CLASSES)
    suffix = "\n".join(f"WHEN low LIKE '%{e}' THEN '{name}'" for name, e in tk.SUFFIX_CLASSES)
    tags = "\n".join(f"WHEN pos = '{p}' THEN '{t}'" for p, t in tk.TAG_OF_POS.items())
    deps = "\n".join(f"WHEN pos = '{p}' THEN '{d}'" for p, d in tk.DEP_OF_POS.items())
    return f"""{tokens_cte(source)},
posd AS (SELECT *, CASE WHEN NOT regexp_matches(token, '[\\p{{L}}\\p{{N}}]') THEN 'PUNCT'
    WHEN regexp_matches(token, '^[0-9]+$') THEN 'NUM'
    {closed}
    WHEN regexp_matches(token, '^\\p{{Lu}}') AND sent_pos > 0 THEN 'PROPN'
    {suffix}
    ELSE 'NOUN' END AS pos FROM tok),
near AS (SELECT *, lag(pos) OVER s AS prev_pos, lead(pos) OVER s AS next_pos,
    lag(low) OVER s AS prev_low, lead(low) OVER s AS next_low,
    first_value(token_id) OVER s AS first_id,
    max(CASE WHEN pos <> 'PUNCT' THEN token_id END) OVER
      (PARTITION BY doc_id, sentence_id ORDER BY sent_pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS word_before
  FROM posd WINDOW s AS (PARTITION BY doc_id, sentence_id ORDER BY sent_pos)),
ann AS (SELECT doc_id, sentence_id, sent_pos, token_id, token, low, pos, prev_pos, next_pos,
    CASE WHEN pos = 'AUX' THEN 'be' ELSE low END AS lemma,
    CASE WHEN low IN ('who', 'what') THEN 'WP' WHEN low = 'which' THEN 'WDT'
         WHEN pos = 'PRON' THEN 'PRP' WHEN low = 'is' THEN 'VBZ' WHEN pos = 'AUX' THEN 'VBP'
         WHEN pos = 'VERB' AND low LIKE '%ing' THEN 'VBG' WHEN pos = 'VERB' THEN 'VBD'
         {tags} END AS tag,
    CASE WHEN pos = 'VERB' AND low LIKE '%ing' THEN 'VerbForm=Ger'
         WHEN pos = 'VERB' THEN 'Tense=Past|VerbForm=Fin'
         WHEN pos IN ('NOUN', 'PROPN') THEN 'Number=Sing'
         WHEN token IN ('.', '!', '?') THEN 'PunctType=Peri' ELSE '' END AS morph,
    coalesce(word_before, first_id) AS head_token_id,
    CASE WHEN sent_pos = 0 THEN 'ROOT'
         {deps}
         WHEN pos = 'AUX' AND next_pos = 'VERB' AND next_low LIKE '%ed' THEN 'auxpass'
         WHEN pos = 'AUX' THEN 'aux'
         WHEN pos = 'VERB' AND prev_low IN ('who', 'which') THEN 'relcl'
         WHEN pos = 'VERB' THEN 'conj'
         WHEN pos IN ('NOUN', 'PROPN') AND prev_pos = 'VERB' THEN 'dobj'
         WHEN pos IN ('NOUN', 'PROPN') AND prev_pos = 'AUX' THEN 'attr'
         WHEN pos IN ('NOUN', 'PROPN') AND prev_pos = 'ADP' THEN 'pobj'
         WHEN pos IN ('NOUN', 'PROPN') THEN 'compound'
         ELSE 'dep' END AS dep,
    pos = 'PUNCT' AS is_punct, pos IN {in_list(tk.STOP_CLASSES)} AS is_stop,
    CASE WHEN pos = 'PROPN' THEN 'PERSON' WHEN pos = 'NUM' THEN 'DATE' ELSE '' END AS ent_type
  FROM near)"""
