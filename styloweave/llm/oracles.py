"""Check SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from styloweave.llm import op03_divergence as divergence
from styloweave.llm.op07_chat import CONTROLS

_WORDS = r"""w AS (SELECT doc_id, coalesce(text, '') AS text, lang,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def divergence_sql() -> str:
    every = sorted({w for words in divergence.COMMON.values() for w in words})
    lists = [(lang, w, i) for lang, words in {**divergence.COMMON, "": every}.items() for i, w in enumerate(words)]
    rows = ", ".join(f"({_quoted(a)}, {_quoted(b)}, {i})" for a, b, i in lists)
    langs = ", ".join(map(_quoted, divergence.COMMON))

    def count(kind: str) -> str:
        return f"length(text) - length(regexp_replace(text, {_quoted(kind)}, '', 'g'))"

    return f"""WITH {_WORDS},
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM p
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
inside AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
c AS (SELECT w.doc_id, coalesce(lang, '') AS lang, len(ws) AS n_words,
    coalesce(length(array_to_string(ws, '')), 0) AS word_chars, length(text) AS n_chars, {count('[#*$%&|<>]+')} AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words,
    {count('[a-z]+')} AS c_lower, {count('[\\p{Lu}]+')} AS c_upper, {count('[0-9]+')} AS c_digit,
    {count("[.,;:!?'\"()-]+")} AS c_mark
  FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN inside ON w.doc_id = inside.doc_id),
chars AS (SELECT doc_id, lang, unnest([n_chars - word_chars, c_lower, c_upper, c_digit, c_mark, n_symbols,
    word_chars - c_lower - c_upper - c_digit - c_mark - n_symbols]) AS n, unnest(range(7)) AS bin FROM c),
lists(lang, word, bin) AS (VALUES {rows}),
listed AS (SELECT p.doc_id, lists.bin, count(*) AS n FROM p JOIN c ON p.doc_id = c.doc_id JOIN lists
    ON lists.word = lower(p.word) AND lists.lang = CASE WHEN c.lang IN ({langs}) THEN c.lang ELSE '' END
  WHERE length(p.word) <= 6 GROUP BY p.doc_id, lists.bin),
common AS (SELECT c.doc_id, c.lang, listed.n, listed.bin FROM listed JOIN c ON c.doc_id = listed.doc_id UNION ALL
  SELECT c.doc_id, c.lang, n_words - coalesce(s, 0), -1 FROM c LEFT JOIN
    (SELECT doc_id, sum(n) AS s FROM listed GROUP BY doc_id) t ON c.doc_id = t.doc_id),
hist AS (SELECT 'c' AS kind, doc_id, lang, bin, n FROM chars UNION ALL SELECT 'w', doc_id, lang, bin, n FROM common),
ref AS (SELECT kind, lang, bin, CAST(sum(n) AS DOUBLE) AS n FROM hist GROUP BY ALL),
share AS (SELECT kind, lang, bin, n / sum(n) OVER (PARTITION BY kind, lang) AS q FROM ref),
total AS (SELECT kind, doc_id, lang, CAST(sum(n) AS DOUBLE) AS n FROM hist GROUP BY ALL),
js AS (SELECT total.kind, total.doc_id, any_value(total.n) AS n, sqrt(greatest(sum(
    CASE WHEN x > 0 THEN x * log2(x / ((x + share.q) / 2)) ELSE 0 END
    + CASE WHEN share.q > 0 THEN share.q * log2(share.q / ((x + share.q) / 2)) ELSE 0 END) / 2, 0)) AS d
  FROM (SELECT total.*, share.bin, share.q, coalesce(h.n, 0) / total.n AS x FROM total
        JOIN share ON share.kind = total.kind AND share.lang = total.lang
        LEFT JOIN hist h ON h.kind = total.kind AND h.doc_id = total.doc_id AND h.bin = share.bin WHERE total.n > 0) z
  JOIN total ON total.kind = z.kind AND total.doc_id = z.doc_id JOIN share ON share.kind = z.kind AND share.lang = z.lang
    AND share.bin = z.bin GROUP BY total.kind, total.doc_id),
v AS (SELECT c.*, n_words < {divergence.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (coalesce(a.n, 0) >= {divergence.MIN_CHARS} AND a.d > {divergence.MAX_CHAR_DISTANCE}) AS far_chars,
    (coalesce(b.n, 0) >= {divergence.MIN_COUNTED} AND b.d > {divergence.MAX_WORD_DISTANCE}
      + {divergence.WORD_NOISE} / sqrt(n_words)) AS far_words
  FROM c LEFT JOIN js a ON a.doc_id = c.doc_id AND a.kind = 'c' LEFT JOIN js b ON b.doc_id = c.doc_id AND b.kind = 'w')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(far_chars, false) AND NOT coalesce(far_words, false) AS kept FROM v"""


NEAR = f"""WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS s
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k) r WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE shared >= 0.8 * (na.n + nb.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, f.b FROM reach JOIN both_ways f ON reach.b = f.a)
SELECT w.doc_id, coalesce(least(w.doc_id, m.b), w.doc_id) AS class_id, CAST(len(ws) AS BIGINT) AS n_words
FROM w LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = w.doc_id"""

SUBSTRINGS = f"""WITH {_WORDS},
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i) r WHERE len(ws) >= 50),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM k),
  (SELECT unnest(range(50)) AS d) r WHERE least < doc_id),
o AS (SELECT p.doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY p.i) AS kept
  FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o ON o.doc_id = w.doc_id"""

_NORMAL = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
CONTAMINATION = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_NORMAL} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[k:k + 12], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k) r WHERE len(ws) > 0),
w AS (SELECT doc_id, {_NORMAL} AS ws FROM documents),
dw AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM w, (SELECT DISTINCT n FROM iw) s,
  LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS k) r),
m AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT k + d) AS n_hit FROM m, LATERAL (SELECT unnest(range(m.n)) AS d) r GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN i ON i.doc_id = w.doc_id"""


def chat_sql() -> str:
    pattern = "(\\\\|" + "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in CONTROLS) + ")"

    def escaped(column: str) -> str:
        return f"length(regexp_replace({column}, {_quoted(pattern)}, 'x\\1', 'g'))"

    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -1, v.* FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) v)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum({escaped('text')} + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 4
    ELSE 19 + {escaped('role')} END) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""


ORACLES = {"op3_divergence": divergence_sql(), "op4_near_dedup": NEAR, "op5_substring_dedup": SUBSTRINGS,
           "op7_chat_formatting": chat_sql(), "op10_decontamination": CONTAMINATION}
