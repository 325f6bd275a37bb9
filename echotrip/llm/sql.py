"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NEAR_DUPS = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

REPEATS = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m
  FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 399, 0))) AS i FROM bytes)),
hits AS (SELECT doc_id, i FROM starts WHERE m IN (SELECT m FROM starts GROUP BY m HAVING count(*) > 1)),
edges AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits),
islands AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island
  FROM edges),
spans AS (SELECT doc_id, min(i) AS b, max(i) + 400 AS e FROM islands GROUP BY doc_id, island),
gaps AS (SELECT doc_id, e, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS next FROM spans),
sums AS (SELECT doc_id, min(b) AS first, sum(e - b) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
rest AS (
  SELECT doc_id, string_agg(substr(h, 2 * e + 1, 2 * (coalesce(next, len(h) // 2) - e)), '' ORDER BY e) AS tail
  FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE substr(h, 1, 2 * first) || tail END)) AS kept_sha256
FROM bytes LEFT JOIN sums USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

PERSPECTIVES = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, CAST(floor(turn / 256.0) AS BIGINT) AS block
  FROM conversations WHERE conv_id IS NOT NULL),
parts AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text) - 1) // 1024 AS part FROM said),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
seen AS (
  SELECT parts.*, speaker, role = speaker AS mine,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head
  FROM parts JOIN speakers USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (
    PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM seen)
SELECT conv_id, speaker, block, part, count(*) AS n_turns, CAST(min(place) AS BIGINT) AS start,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg((place + length(head)) || '-' || (place + length(head) + length(text) + 7), ' '
    ORDER BY turn NULLS FIRST, role, text) FILTER (mine), '') AS mask,
  CAST(coalesce(sum(length(text) + 7) FILTER (mine), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, speaker, block, part
"""

HOST_RULES = f"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM texts WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(w) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(w) AS base_failed
  FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f0, count(*) FILTER (100 * n_symbols > 10 * n_words) AS f1,
    count(*) FILTER (100 * n_dup_lines > 5 * n_words) AS f2, count(*) FILTER (word_chars < 3 * n_words OR word_chars > 10 * n_words) AS f3
  FROM measured WHERE source IS NOT NULL GROUP BY source),
rules AS (SELECT source, n, unnest([0, 1, 2, 3]) AS r, unnest([f0, f1, f2, f3]) AS f FROM hosts),
means AS (SELECT r, sum(f) / sum(n) AS m FROM rules GROUP BY r),
priors AS (SELECT r, m, sum(n * (f / n - m) ** 2) / sum(n) AS v FROM rules JOIN means USING (r) GROUP BY r, m),
shrunk AS (SELECT source, m, n + greatest(1, m * (1 - m) / v - 1) AS seen,
  (f + m * greatest(1, m * (1 - m) / v - 1)) / (n + greatest(1, m * (1 - m) / v - 1)) AS rate FROM rules JOIN priors USING (r) WHERE v > 0),
verdicts AS (SELECT source, bool_or(rate - 3 * sqrt(rate * (1 - rate) / (seen + 1)) > 2 * m) AS host_rejected FROM shrunk GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(host_rejected, false) AS host_rejected, NOT base_failed AND NOT coalesce(host_rejected, false) AS kept
FROM measured LEFT JOIN verdicts USING (source)
"""

VECTOR_DUPS = """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts USING (vec_id)
"""

FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
# Truncating division as floor division.
FLOOR_MEAN = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _rounds(n: int, parts: str) -> str:
    """Entries ``c0`` to ``c{n}`` and the assignments ``near0`` to ``near{n}`` to them; ``parts`` are columns that cells and entries share."""
    out = ""
    for r in range(n + 1):
        out += f""",
dist{r} AS MATERIALIZED (
  SELECT rid, {parts}k, CAST(sum((a.x - c.x) * (a.x - c.x)) AS BIGINT) AS s FROM cells a JOIN c{r} c USING ({parts}d) GROUP BY ALL),
near{r} AS MATERIALIZED (SELECT * FROM dist{r} QUALIFY row_number() OVER (PARTITION BY {parts}rid ORDER BY s, k) = 1)"""
        if r < n:
            out += f""",
c{r + 1} AS MATERIALIZED (
  SELECT {parts}k, d, CASE WHEN n IS NULL THEN x ELSE {FLOOR_MEAN} END AS x FROM c{r}
  LEFT JOIN (SELECT {parts}k, d, sum(x) AS s, count(*) AS n FROM cells JOIN near{r} USING ({parts}rid) GROUP BY ALL) USING ({parts}k, d))"""
    return out


CLUSTERS = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {FINITE}),
cells AS MATERIALIZED (SELECT rid, unnest(range(64)) AS d, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT k, unnest(range(64)) AS d, unnest(v) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v FROM kept) WHERE k < 8){_rounds(10, "")},
digests AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c10 GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, s AS distance, CAST(sum(s) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(s) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near10 JOIN kept USING (rid) JOIN digests USING (k)
"""

VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND {FINITE}),
flat AS (SELECT rid, unnest(range(len(v))) AS i, len(v) // 8 AS size, unnest(v) AS x FROM kept),
cells AS MATERIALIZED (SELECT rid, i // size AS p, i % size AS d, x FROM flat),
c0 AS MATERIALIZED (
  SELECT p, k, d, x FROM cells JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept) USING (rid)
  WHERE k < 16){_rounds(6, "p, ")},
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, d)) AS codebooks_sha256 FROM c6),
coded AS (SELECT rid, string_agg(lower(printf('%02x', k)), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM near6 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid) JOIN digest ON true
"""

ORACLE: dict[str, str] = {
    "op2_minhash": NEAR_DUPS,
    "op4_repeats": REPEATS,
    "op5_perspectives": PERSPECTIVES,
    "op6_host_rules": HOST_RULES,
    "op9_vector_dups": VECTOR_DUPS,
    "op11_clusters": CLUSTERS,
    "op12_vector_codes": VECTOR_CODES,
}
