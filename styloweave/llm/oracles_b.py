"""Check SQL of the Merkle manifest and of structure repair, over whole tables."""

from __future__ import annotations

# CRC-32 of a string of ASCII characters, from a table that the first lines make
_CRC_TABLE = """crc_step(i, k, v) AS (SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM crc_step WHERE k < 8),
crc(tab) AS (SELECT list(v ORDER BY i) FROM crc_step WHERE k = 8)"""


def _crc(text: str) -> str:
    return (f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT)), "
            "lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295))")


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, base: str) -> str:
    """Nodes of all levels, and each node's siblings."""
    return f"""{name}(k, level, idx, n, h) AS ({base} UNION ALL
  SELECT k, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1
  GROUP BY k, level, idx // 8, n),
{name}_sides AS (SELECT a.k, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
  coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after FROM {name} a JOIN {name} b
  ON a.k = b.k AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.k, a.level, a.idx)"""


MERKLE = f"""WITH RECURSIVE {_CRC_TABLE},
l AS (SELECT doc_id, coalesce('1' || lang, '0') AS k, {_leaf('text')} AS leaf,
  CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END AS found FROM documents, crc),
o AS (SELECT *, row_number() OVER (ORDER BY k, doc_id NULLS FIRST, leaf) AS r,
  row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM l),
{_tree("t", "SELECT k, 0, idx, n, leaf FROM o")},
subroots AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
{_tree("u", "SELECT '', 0, idx, n, h FROM subroots")},
steps AS (SELECT r, level, before, after FROM o JOIN t_sides s ON s.k = o.k AND s.idx = o.idx // CAST(8 ** level AS BIGINT) UNION ALL
  SELECT r, 100 + level, before, after FROM o JOIN subroots ON subroots.k = o.k
  JOIN u_sides s ON s.idx = subroots.idx // CAST(8 ** level AS BIGINT)),
way AS (SELECT r, before, after, row_number() OVER (PARTITION BY r ORDER BY level) AS i FROM steps),
fold(r, i, h) AS (SELECT r, 0, found FROM o UNION ALL
  SELECT fold.r, fold.i + 1, sha256(before || h || after) FROM fold JOIN way ON way.r = fold.r AND way.i = fold.i + 1),
last AS (SELECT r, arg_max(h, i) AS h FROM fold GROUP BY r),
proof AS (SELECT r, string_agg(before || after, '' ORDER BY i) AS p FROM way GROUP BY r)
SELECT o.doc_id, o.leaf, subroots.h AS subroot, u.h AS root, sha256(coalesce(p, '')) AS proof_sha256, last.h AS folded_root,
  last.h = u.h AS verified
FROM o JOIN subroots ON subroots.k = o.k JOIN (SELECT h FROM u WHERE n = 1) u ON true JOIN last ON last.r = o.r
LEFT JOIN proof ON proof.r = o.r"""

_KEEP_OR_NAME = {c: f"CASE WHEN f IN (0, 3) THEN CASE WHEN first = '{c}' THEN 0 ELSE 2 END + t ELSE 1000000 END" for c in "ua"}
# costs to go (b0 to b3) of the four states: nothing yet, after s, after u, after a
REPAIR = rf"""WITH RECURSIVE {_CRC_TABLE},
n AS (SELECT coalesce('1' || conv_id, '0') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS d FROM conversations, crc),
r AS (SELECT k, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
  CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM n, LATERAL (SELECT unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) c),
p AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS c, left(role, 1) AS first FROM
  (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM r)),
o AS (SELECT *, CASE f WHEN 3 THEN 1 ELSE 0 END AS t, lag(first) OVER (PARTITION BY k ORDER BY i) AS prev FROM (SELECT *,
  CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN c > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS f FROM p)),
s AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank,
  count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
  count(*) FILTER (prev IS NOT NULL AND prev || first NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY k),
b(k, i, b0, b1, b2, b3) AS (SELECT k, n + 1, 0, 4, 2, 0 FROM s UNION ALL
  SELECT k, i, least(c0, 2 + c2, 4 + c3), least(c1, 2 + c2, 4 + c3), least(c2, 2 + c3), least(c3, 2 + c2) FROM (
    SELECT b.k, o.i, least(3 + b0, {_KEEP_OR_NAME['u']} + b2, CASE WHEN f IN (0, 3) AND first = 's' THEN t + b1 ELSE 1000000 END) AS c0,
      least(3 + b1, {_KEEP_OR_NAME['u']} + b2) AS c1, least(3 + b2, {_KEEP_OR_NAME['a']} + b3) AS c2,
      least(3 + b3, {_KEEP_OR_NAME['u']} + b2) AS c3 FROM b JOIN o ON o.k = b.k AND o.i = b.i - 1)),
v AS (SELECT k, i, unnest([0, 1, 2, 3]) AS s, unnest([b0, b1, b2, b3]) AS cost, unnest([2, 2, 3, 2]) AS nxt,
  unnest([b2, b2, b3, b2]) AS after_nxt, b1 FROM b),
q AS (SELECT v.k, v.i, v.s, v.nxt, o.i IS NULL AS over, role, text, first, coalesce(t, 0) AS t, v.cost,
  CASE WHEN o.i IS NULL THEN CASE WHEN v.s IN (0, 3) THEN 'E' ELSE 'I' END WHEN 3 + w.cost = v.cost THEN 'D'
    WHEN 2 + v.after_nxt = v.cost THEN 'I'
    WHEN f IN (0, 3) AND v.s = 0 AND first = 's' AND t + w.b1 = v.cost THEN 'S'
    WHEN f IN (0, 3) AND first = CASE v.nxt WHEN 2 THEN 'u' ELSE 'a' END AND t + w.after_nxt = v.cost THEN 'K' ELSE 'R' END AS e
  FROM v LEFT JOIN o ON o.k = v.k AND o.i = v.i LEFT JOIN v w ON w.k = v.k AND w.i = v.i + 1 AND w.s = v.s),
g(k, i, s, audit, body, made) AS (SELECT k, 1, 0, '', '', 0 FROM s UNION ALL
  SELECT g.k, CASE e WHEN 'I' THEN g.i ELSE g.i + 1 END, CASE e WHEN 'D' THEN g.s WHEN 'S' THEN 1 ELSE nxt END,
    audit || CASE e WHEN 'S' THEN 'K' ELSE e END, CASE WHEN e = 'D' THEN body ELSE body || CASE WHEN body = '' THEN '' ELSE chr(10) END
      || CASE WHEN e IN ('S', 'K') THEN role WHEN nxt = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END END, made + 1
  FROM g JOIN q ON q.k = g.k AND q.i = g.i AND q.s = g.s WHERE e <> 'E'),
e AS (SELECT k, arg_max(audit, made) AS audit, arg_max(body, made) AS body FROM g GROUP BY k)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b0, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('1' || conv_id, '0') AS k FROM conversations) ids LEFT JOIN s ON s.k = ids.k
LEFT JOIN e ON e.k = ids.k LEFT JOIN b ON b.k = ids.k AND b.i = 1"""

ORACLES = {"op11_structure_repair": REPAIR, "op12_merkle_manifest": MERKLE}
