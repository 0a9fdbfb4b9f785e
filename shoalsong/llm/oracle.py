"""SQL for DuckDB that answers the queries by brute force, where SQL can express them."""

from __future__ import annotations

from shoalsong.llm import chat, fim, lexical

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

# Smallest id reachable over the links (a, b) of rows (id): every row that can reach a smaller one passes it on.
REACHED = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT a AS id, b AS other FROM both_ways
  UNION SELECT r.id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
lowest AS (SELECT id, least(id, min(other)) AS component_id FROM reached GROUP BY id)"""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hex_digits: str) -> str:
    """Of 40 hexadecimal digits: every five are four characters."""
    parts = []
    for i in range(8):
        value = f"('0x' || substr({hex_digits}, {5 * i + 1}, 5))::BIGINT"
        parts += [f"substr('{BASE32}', (({value} >> {shift}) & 31)::INTEGER + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(parts)


OP1 = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT sha1(payload) AS h, octet_length(payload) AS n, * FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, {_base32('h')} AS payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, url
FROM m
"""

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT r, {WORDS.format('t')} AS words FROM d)),
g AS (
  SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM g WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, w, w2, w3) > 1),
inside AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
words AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
lines AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
texts AS (SELECT DISTINCT source, text FROM d WHERE text IS NOT NULL),
numbered AS (SELECT row_number() OVER () AS k, * FROM texts),
plain AS (
  SELECT k, source, trim(regexp_replace(translate(lower(line), '123456789' || chr(9) || chr(11) || chr(12) || chr(13), '000000000    '), ' {{2,}}', ' ', 'g'), ' ') AS line
  FROM (SELECT k, source, unnest(string_split(text, chr(10))) AS line FROM numbered)),
held AS (SELECT *, len(string_split(line, ' ')) AS n FROM plain WHERE line <> ''),
hosts AS (SELECT source, count(*) AS n_texts FROM numbered GROUP BY source),
frequent AS (
  SELECT f.source, line FROM (SELECT source, line, count(DISTINCT k) AS n_docs FROM held GROUP BY ALL) f
  JOIN hosts h ON h.source IS NOT DISTINCT FROM f.source WHERE n_docs > 20 AND n_docs > 0.05::DOUBLE * n_texts),
lost AS (
  SELECT k, sum(n) FILTER (f.line IS NOT NULL) AS lost, sum(n) AS total
  FROM held h LEFT JOIN frequent f ON f.source IS NOT DISTINCT FROM h.source AND f.line = h.line GROUP BY k),
judged AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words,
         100 * coalesce(lost, 0) > 50 * total AS depleted
  FROM d LEFT JOIN words USING (r) LEFT JOIN dups USING (r) LEFT JOIN inside USING (r)
  LEFT JOIN numbered k ON k.text = d.text AND k.source IS NOT DISTINCT FROM d.source LEFT JOIN lost USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(depleted, false) AS kept, n_lost_words
FROM judged
"""

OP5 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
{REACHED},
counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN lowest ON id = vec_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  JOIN sizes nx ON nx.doc_id = x.doc_id JOIN sizes ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
{REACHED}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON id = doc_id
"""

OP8 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER o, 0) AS full_words, coalesce(sum(weight) OVER o, 0) AS full_weights
  FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
-- With the sources before this one at their limit, the level for the rest; the true one is the first that this source bears.
l AS (SELECT *, (total - full_words)::DOUBLE / (weights - full_weights) AS level FROM c),
level AS (SELECT arg_min(level, 3 * source_size / weight) AS level FROM l WHERE level * weight <= 3 * source_size),
t AS (SELECT source, source_size, CASE WHEN total > 0 THEN least((3 * source_size)::DOUBLE, (SELECT level FROM level) * weight) ELSE 0.0 END AS target FROM c),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS words,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id NULLS FIRST, d.size
                            ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS first
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ({' + '.join(f'greatest(0, least({k} * source_size + first + size, words) - ({k} * source_size + first))' for k in range(3))})::BIGINT AS taken
FROM p
"""

ORACLE = {
    "op1_warc": OP1,
    "op2_perspectives": chat.ORACLE,
    "op3_line_frequency": OP3,
    "op5_metric_join": OP5,
    "op6_minhash": OP6,
    "op8_mixing": OP8,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
