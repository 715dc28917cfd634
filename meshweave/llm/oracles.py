"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality

_SPACE = r"[\x20\x09-\x0D]"
_SEPARATORS = "'|', '»', '›', '>', '•', '·', '/', '–', '—', '-', '::'"
_CLOSING = quality.CLOSING.replace("'", "''")

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS words, string_split(t, chr(10)) AS lines FROM d),
windows AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY doc_id),
l AS (SELECT doc_id, line, len(string_split_regex(line, '{_SPACE}+')) AS n, list_filter(string_split_regex(line, '{_SPACE}+'), lambda x: x <> '') AS words
      FROM (SELECT doc_id, unnest(lines) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
passing AS (SELECT doc_id, sum(length(regexp_replace(line, '{_SPACE}', '', 'g'))) AS chars FROM l
      WHERE (n < {quality.HEADING_WORDS} OR contains('{quality.TERMINAL}', right(rtrim(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_CLOSING}'), 1)))
      AND len(regexp_extract_all(line, '{quality.SYMBOLS}')) <= {quality.MOST_SYMBOLS} * length(line)
      AND len(list_filter(words, lambda x: x IN ({_SEPARATORS}))) <= {quality.MOST_SEPARATORS} * n
      AND NOT (n <= {quality.NOTICE_WORDS} AND regexp_matches(line, '(?i){quality.BOILERPLATE}'))
      GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols,
      coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(passing.chars, 0) AS left_chars
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN passing USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_chars >= {1 - quality.MOST_LOST} * word_chars AS kept FROM f
"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(words) < 2 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, a AS reached FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reached),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, coalesce(c.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
