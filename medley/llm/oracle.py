"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from medley.llm.ngrams import BACKOFF, LEAST
from medley.llm.quality import BOILERPLATE, MIN_WORDS

SQL: dict[str, str] = {}

SPACE = r"\x20\x09-\x0D"
_low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_roots = "SELECT v, min(r) AS component_id FROM reach GROUP BY v"

SQL["op3_minhash_duplicates"] = rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_low}, '[^{SPACE}]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
one AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
           FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM sized UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v),
roots AS ({_roots})
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN roots ON v = doc_id
"""

SQL["op4_quantised_vectors"] = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
unit AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM e WHERE x IS NOT NULL AND len(x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
          AND list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.95e0 WHERE a.size > 0 AND b.size > 0),
reach AS (SELECT vec_id AS v, vec_id AS r FROM e UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.v),
roots AS ({_roots}),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN roots ON v = vec_id LEFT JOIN counts ON a = vec_id
"""

SQL["op5_backoff_scores"] = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all({_low}, '[^{SPACE}]+') AS w FROM documents),
coded AS (SELECT doc_id, unnest(w) AS w3, generate_subscripts(w, 1) AS i FROM split),
grams AS (SELECT doc_id, w3, lag(w3, 1, ' start') OVER o AS w2, lag(w3, 2, ' start') OVER o AS w1 FROM coded WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c3 AS (SELECT w1, w2, w3, count(*) AS c FROM grams GROUP BY ALL),
x3 AS (SELECT w1, w2, sum(c) AS x FROM c3 GROUP BY ALL),
c2 AS (SELECT w2, w3, sum(c) AS c FROM c3 GROUP BY ALL),
x2 AS (SELECT w2, sum(c) AS x FROM c2 GROUP BY ALL),
c1 AS (SELECT w3, sum(c) AS c FROM c2 GROUP BY ALL),
total AS (SELECT sum(c) AS n FROM c1),
scores AS (SELECT c3.*, CASE WHEN c3.c >= {LEAST} THEN ln(c3.c / x3.x) WHEN c2.c >= {LEAST} THEN ln({BACKOFF}e0) + ln(c2.c / x2.x)
           ELSE 2 * ln({BACKOFF}e0) + ln(c1.c / n) END AS score
           FROM c3 JOIN x3 USING (w1, w2) JOIN c2 USING (w2, w3) JOIN x2 USING (w2) JOIN c1 USING (w3) CROSS JOIN total),
sums AS (SELECT doc_id, count(*) AS n_words, sum(score) AS s FROM grams JOIN scores USING (w1, w2, w3) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(s, 0e0), 4) AS log_score, round(s / n_words, 4) AS mean_score
FROM documents LEFT JOIN sums USING (doc_id)
"""

_phrases = "|".join(p.decode() for p in BOILERPLATE)
SQL["op10_line_quality"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
split AS (SELECT doc_id, x, regexp_extract_all(x, '[^{SPACE}]+') AS w FROM d),
parts AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '[^{SPACE}]+') AS w, regexp_replace(line, '[{SPACE}]+', '', 'g') AS solid FROM parts),
judged AS (SELECT doc_id, line, strlen(solid) AS size,
             strlen(solid) - strlen(regexp_replace(solid, '[!-+\x2D/:-@\[-`{{-~]', '', 'g')) > 0.1e0 * strlen(solid)
             OR len(regexp_extract_all(line, '\||>>')) > 1 OR (len(regexp_extract_all(line, '\||>>')) = 1 AND len(w) <= 6)
             OR (len(w) >= 10 AND list_max(map_values(list_histogram(w))) > 0.5e0 * len(w))
             OR regexp_matches(line, '(?i){_phrases}') AS bad
           FROM lines WHERE len(w) > 0),
by_line AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(size) FILTER (WHERE bad), 0) AS lost FROM judged GROUP BY doc_id),
windows AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'k': array_to_string(w[i:i + 2], ' ')}})) AS g FROM split WHERE len(w) > 3),
often AS (SELECT doc_id, g.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g.k) > 1),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(x, '[{SPACE}]+', '', 'g')) AS word_chars, strlen(regexp_replace(x, '[{SPACE}]+', '', 'g')) AS word_bytes,
         length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(hits.n, 0) AS n_repeat_words,
         coalesce(lost, 0) AS lost FROM split LEFT JOIN by_line USING (doc_id) LEFT JOIN hits USING (doc_id)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND lost <= 0.3e0 * word_bytes AS kept, CAST(lost AS BIGINT) AS lost_bytes
FROM based
"""

SQL["op11_residue_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
                  list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS c FROM embeddings
           WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
met AS (SELECT a.vec_id AS a, b.vec_id AS b, a.l = b.l AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS s
        FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.c) = len(b.c) WHERE a.vec_id % 100 = 0),
positives AS (SELECT a, b, s FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
negatives AS (SELECT p.a, p.b AS p, p.s AS ps, m.b AS n, m.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY m.s DESC, m.b) AS r
              FROM positives p JOIN met m ON m.a = p.a AND NOT m.same AND 30 * p.s <= 100 * m.s AND 100 * m.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM negatives WHERE r <= 10
"""

# The neighbour graph is complete up to 512 points, where the search is exact; beyond, it is approximate.
SQL["op12_descent_neighbours"] = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
           WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
met AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.x, b.x) AS score
        FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM met)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""
_terms = r"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL["op13_impact_search"] = f"""
WITH d AS (SELECT doc_id, unnest({_terms.format(x=_low)}) AS t FROM documents),
one AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
often AS (SELECT t, count(*) AS df FROM one GROUP BY ALL),
weights AS (SELECT t, CAST(floor(1000e0 * ln((2e0 * docs + 2e0) / (2e0 * df + 1e0))) AS BIGINT) AS w FROM often, total),
measured AS (SELECT doc_id, 75 + (25 * n * docs) // words AS m FROM sizes, total),
q AS (SELECT item_id, t, count(*) AS repeats FROM (SELECT item_id, unnest({_terms.format(x=_low)}) AS t FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, CAST(sum(repeats * (w * ((1000000000 * tf) // (1000 * tf + 12 * m)))) AS BIGINT) AS score
           FROM q JOIN weights USING (t) JOIN one USING (t) JOIN measured USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
