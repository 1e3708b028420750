"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat, mixing, quality, topk, trie

_WORDS = r"'[^\x20\x09-\x0D]+'"
_BLANKS = r"'[\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS words FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, greatest(2, len(words) - 2))])) AS shingle
  FROM w WHERE len(words) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON a = doc_id
"""

CHAT = f"""
WITH c AS (
  SELECT conv_id, count(*) AS n, list({{'r': role, 't': text}} ORDER BY turn) AS turns,
         string_agg('{chat.BEFORE}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{chat.AFTER.strip()}' || chr(10), '' ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id
)
SELECT conv_id, n AS n_turns, text FROM c
WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.turns[1] = c.turns[1] AND d.turns[1:c.n] = c.turns AND (d.n > c.n OR d.n = c.n AND d.conv_id < c.conv_id))
"""

TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _round(i: int) -> str:
    return f"""
cum{i} AS (
  SELECT r.*, sum(size) OVER (PARTITION BY r.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS fits
  FROM open{i} r JOIN left{i} l ON r.source IS NOT DISTINCT FROM l.source WHERE rest > 0 AND size <= rest
),
left{i + 1} AS (
  SELECT l.source, l.rest - coalesce(u.used, 0) AS rest
  FROM left{i} l LEFT JOIN (SELECT source, sum(size) AS used FROM cum{i} WHERE fits GROUP BY source) u ON l.source IS NOT DISTINCT FROM u.source
),
open{i + 1} AS (SELECT doc_id, source, size, draw FROM cum{i} WHERE NOT fits)"""


MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size,
         substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 16) AS draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), r AS (SELECT *, source_size * {float(mixing.EPOCHS)}::DOUBLE AS cap, source_size * {float(mixing.EPOCHS)}::DOUBLE / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r
), t AS (
  SELECT *, CASE WHEN ratio <= level THEN cap ELSE least(cap, weight * coalesce(max(CASE WHEN ratio > level THEN level END) OVER (), level)) END AS target FROM l
), p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
open0 AS (SELECT doc_id, source, size, draw FROM sized), left0 AS (SELECT source, target - whole * source_size AS rest FROM p),
{', '.join(_round(i) for i in range(mixing.ROUNDS))},
extra AS ({' UNION ALL '.join(f'SELECT doc_id, source, size FROM cum{i} WHERE fits' for i in range(mixing.ROUNDS))})
SELECT d.doc_id, d.size, p.source_size, p.target, (d.size * (p.whole + CASE WHEN x.doc_id IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM sized d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN extra x ON d.doc_id = x.doc_id
"""


def _rules() -> str:
    named = {"mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END", "symbol_ratio": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END", "stop_word_ratio": "CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END", "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END"}
    tests = [f"{named.get(r.measure, r.measure)} {op} {bound}" for r in quality.RULES for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return " AND ".join(tests)


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, {_BLANKS}, '', 'g') <> '') AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM c, (VALUES (0), (1), (2)) AS o(j) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT l.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, {_BLANKS}, '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda w: lower(w) IN ({', '.join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))})))::BIGINT AS n_stop_words,
         coalesce(list_max(list_transform(words, lambda w: length(w))), 0)::BIGINT AS longest_word_chars
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept, n_stop_words, longest_word_chars FROM f
"""

TRIE = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), crc_table AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)
), crc_list AS (SELECT list(v ORDER BY i) AS t FROM crc_table),
plans AS (
  SELECT conv_id, conv_id - conv_id % {trie.GROUP} AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % {trie.OPENINGS} AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc_list
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS d, role, text FROM (
    SELECT p.conv_id, 0 AS own, o.place, role, text FROM plans p JOIN o ON o.conv_id = p.base AND o.place <= h
    UNION ALL SELECT p.conv_id, 1, o.place, role, text FROM plans p JOIN o ON o.conv_id = p.conv_id AND o.place > h)
), steps AS (
  SELECT conv_id, d, length(text) AS chars, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM plans
), nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM steps GROUP BY d, k),
lengths AS (SELECT conv_id, max(d) AS d FROM steps GROUP BY conv_id),
ended AS (SELECT s.d, s.k, sha256(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id)) AS digest FROM steps s JOIN lengths l ON l.conv_id = s.conv_id AND l.d = s.d GROUP BY ALL),
parents AS (
  SELECT n.d, n.k, p.conv_id AS parent, p.k AS parent_k FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.d = n.d - 1 JOIN nodes p ON p.d = s.d AND p.k = s.k
), children AS (SELECT d - 1 AS d, parent_k AS k, count(*) AS n FROM parents GROUP BY ALL),
below AS (
  SELECT s.d, s.k, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved
  FROM nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.d <= n.d LEFT JOIN children c ON c.d = n.d AND c.k = n.k GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, parent AS parent_conv_id, n_convs, coalesce(c.n, 0)::BIGINT AS n_children, n_leaves, saved AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN parents p ON p.d = n.d AND p.k = n.k LEFT JOIN children c ON c.d = n.d AND c.k = n.k LEFT JOIN ended e ON e.d = n.d AND e.k = n.k JOIN below b ON b.d = n.d AND b.k = n.k
"""

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": NEAR_DEDUP,
    "op2_chat_format": CHAT,
    "op5_exact_top_k": TOP_K,
    "op8_mix_sources": MIXING,
    "op9_quality_rules": QUALITY,
    "op13_prefix_trie": TRIE,
}
