"""DuckDB SQL of the queries of decontamination, WARC files, the rules' ablation and the base spans of personal data."""

from bookpulse.llm import q_quality

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS ws FROM benchmark
), w AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS size, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS u(i) WHERE len(ws) > 0
), g AS (
  SELECT r, i, size, array_to_string(ws[i : i + size - 1], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM w) AS s, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS u(i)
), m AS (
  SELECT r, i, size, item_id FROM g JOIN w USING (size, win)
), h AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM m)) GROUP BY r
), it AS (
  SELECT r, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM m WHERE item_id IS NOT NULL GROUP BY r
), x AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, coalesce(items, CAST([] AS VARCHAR[])) AS items
  FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
)
SELECT doc_id, n_words, n_hit, CAST(len(items) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM x
"""

# Base 32 of 40 hexadecimal digits: five of them are 20 bits, four characters.
_BASE32 = "array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '')"

WARC = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p
"""

ABLATION = f"""
SELECT rule, CAST(sum(CASE WHEN fail_bits & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejected, CAST(sum(CASE WHEN fail_bits = bit THEN 1 ELSE 0 END) AS BIGINT) AS rejected_alone
FROM ({q_quality.ORACLE}) AS ledger, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 8), ('long_words', 16), ('repeated_lines', 32)) AS v(rule, bit)
GROUP BY rule
"""

_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
_FOUND = " UNION ALL ".join(f"SELECT r, {o} AS o, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d" for o, p in enumerate(_PATTERNS, 1))
_FROM_RIGHT = "CAST(substr(digits, CAST(length(digits) - i + 1 AS INTEGER), 1) AS INTEGER)"
_LUHN = f"list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_FROM_RIGHT} ELSE 2 * {_FROM_RIGHT} - CASE WHEN {_FROM_RIGHT} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"

PII_BASE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  {_FOUND}
), s AS (
  SELECT r, o, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS digits,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM m, unnest(range(1, len(ms) + 1)) AS u(i)
), ok AS (
  SELECT r, o, start, start + length(m) AS stop FROM s WHERE CASE o WHEN 1 THEN true
    WHEN 2 THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 3 THEN length(digits) BETWEEN 13 AND 19 AND {_LUHN} ELSE length(digits) BETWEEN 9 AND 15 END
), g AS (
  SELECT r, {", ".join(f"count(*) FILTER (WHERE o = {o}) AS n_{k}" for o, k in enumerate(("email", "ip", "card", "phone"), 1))},
         string_agg(['email', 'ip', 'card', 'phone'][o] || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans FROM ok GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone"))}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, list_transform(range(0, 4), lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS INTEGER), 8) AS BIGINT)) AS hs FROM d
), c AS (
  SELECT doc_id, t, us, least(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS i, greatest(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain' WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, coalesce(array_to_string(us[1 : i], ''), '') AS pre, coalesce(array_to_string(us[i + 1 : j], ''), '') AS mid, coalesce(array_to_string(us[j + 1 :], ''), '') AS suf FROM c
)
SELECT doc_id, CAST(len(us) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


def _centroids(rounds: int = 3) -> str:
    """Assignments and centroids of each round, one after the other."""
    nearest = "SELECT r, vec_id, v.v, k, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS d FROM v, {} AS c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1"
    parts = [
        """v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v) ORDER BY k LIMIT 16
)"""
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS ({nearest.format(f'c{i}')})")
        sums = f"SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, unnest(range(1, 65)) AS u(i) GROUP BY k, i"
        parts.append(f"m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM ({sums}) GROUP BY k)")
        parts.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{i} AS m ON c.k = m.k)")
    parts.append(f"a{rounds} AS ({nearest.format(f'c{rounds}')})")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.k = c.k
"""


CENTROIDS = _centroids()

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS g FROM d
), c AS (
  SELECT row_number() OVER () AS k, g, min(doc_id) AS first FROM s WHERE len(g) > 0 GROUP BY g
), e AS (
  SELECT k, len(g) AS n, unnest(g) AS w FROM c
), l AS (
  SELECT a.k AS x, b.k AS y FROM e AS a JOIN e AS b ON a.w = b.w AND a.k < b.k AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), o AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), t AS (
  SELECT k, k AS z FROM c UNION SELECT t.k, o.y FROM t JOIN o ON t.z = o.x
), m AS (
  SELECT t.k, min(first) AS component_id FROM t JOIN c ON t.z = c.k GROUP BY t.k
)
SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN m ON c.k = m.k
"""
