"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

# Every row's words with their place, one row each; a null text has none.
_WORDS = r"""texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
words AS (SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j, len(w) AS n FROM split)"""

QUALITY = rf"""WITH {_WORDS},
windows AS (SELECT rid, j, CASE WHEN j <= n - 4 THEN word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' '
    || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS k FROM words WINDOW o AS (PARTITION BY rid ORDER BY j)),
twice AS (SELECT rid, j, k IS NOT NULL AND count(*) OVER (PARTITION BY rid, k) > 1 AS hit FROM windows),
hits AS (SELECT rid, max(hit::INT) OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM twice),
repeats AS (SELECT rid, sum(hit)::BIGINT AS n FROM hits GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM split),
measures AS (SELECT s.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - list_unique(l))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    (length(t) - length(replace(t, '!!', ''))) // 2 + (length(t) - length(replace(t, '??', ''))) // 2 AS n_shouted
  FROM split s JOIN lines USING (rid) LEFT JOIN repeats r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 2 * n_symbols > n_words OR word_chars < 2 * n_words
    OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines OR 2 * n_shouted > n_words) AS kept
FROM measures"""

SUBSTRINGS = rf"""WITH {_WORDS},
windows AS (SELECT rid, doc_id, j, word, n, CASE WHEN j <= n - 49 AND doc_id IS NOT NULL
    THEN md5(array_to_string(w[j:j + 49], ' ')) END AS k FROM words JOIN (SELECT rid, w FROM split) USING (rid)),
owned AS (SELECT rid, j, word, coalesce(k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id, false) AS hit FROM windows),
marked AS (SELECT rid, j, word,
    max(hit::INT) OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM owned),
kept AS (SELECT rid, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS text FROM marked GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (rid)"""

LINES = r"""WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS j FROM texts),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40 GROUP BY k
    HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5),
marked AS (SELECT rid, j, line, owner IS NOT NULL AND doc_id IS DISTINCT FROM owner AS gone FROM keyed LEFT JOIN often USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
FROM marked JOIN texts USING (rid) GROUP BY rid"""


def _centroids(rounds: int = 5) -> str:
    """Each round as two tables: who is nearest, and the means after it."""
    steps = [
        """v AS (SELECT row_number() OVER () AS rid, vec_id,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS k, x AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id), x) <= 40)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT rid, vec_id, x, k, c,
  list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM v, c{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT k, j, floor(sum(e)::DECIMAL(38, 0) / count(*))::BIGINT AS m FROM
  (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM d{r}) GROUP BY k, j),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT k, list(m ORDER BY j) AS m FROM s{r} GROUP BY k) USING (k))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM d{rounds}"""


CENTROIDS = _centroids()

# The reflected CRC polynomial is 0xEDB88320 = 3988292384.
TRIE = r"""WITH turns AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, list({'x': x, 'w': w} ORDER BY turn NULLS FIRST, x) AS t, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(c::VARCHAR, ''), lambda e: ascii(e)::BIGINT)),
    lambda s, e: list_reduce([xor(s, e), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h
  FROM turns GROUP BY c),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 20),
paths AS (SELECT c, len(t) AS n, unnest(range(0, len(t) + 1)) AS d, t FROM rebuilt),
keyed AS (SELECT c, n, d, sha256(array_to_string(list_transform(t[1:d], lambda y: y.x), ',')) AS k,
    CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(t[1:d - 1], lambda y: y.x), ',')) END AS p, coalesce(t[d].w, 0) AS w FROM paths),
nodes AS (SELECT d, k, min(p) AS p, min(c) AS c, count(*) AS n, max(w) AS w, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS e
  FROM keyed GROUP BY d, k),
kids AS (SELECT d - 1 AS d, p AS k, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (d, k)),
sums AS (SELECT q.d, q.k, sum((v.n - 1) * v.w) AS saved, count(*) FILTER (v.kids = 0) AS leaves
  FROM whole v JOIN keyed q ON q.c = v.c AND q.d <= v.d GROUP BY ALL)
SELECT v.c AS conv_id, v.d AS depth, u.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(v.e) AS ends_sha256 FROM whole v JOIN sums USING (d, k) LEFT JOIN whole u ON u.d = v.d - 1 AND u.k = v.p"""
