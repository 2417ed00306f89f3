"""The queries that SQL can state, for small tables: all windows, and all pairs that share anything."""

from __future__ import annotations

#: Words [^\x20\x09-\x0D]+ of an expression.
_WORDS = r"coalesce(list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> ''), [])"

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS x, CASE WHEN i + 199 <= length(h) // 2 THEN md5(substr(h, 2 * i - 1, 400)) END AS k FROM b),
r AS (SELECT doc_id, i, x, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS again FROM w),
g AS (SELECT doc_id, i, x, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, i, x, gone, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM g),
o AS (SELECT doc_id, sum(gone) AS removed, sum(opens::INT) AS spans, string_agg(x, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS k FROM b),
r AS (SELECT doc_id, i, x, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM k),
g AS (SELECT doc_id, i, x, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
o AS (SELECT doc_id, sum(gone) AS removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""

_REACHED = """
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

VECTORS = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACHED},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, vec_id <= coalesce(low.b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS m, any_value(q.n) AS n, count(*) AS shared FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id),
links AS (SELECT a, b FROM c WHERE 100 * shared >= 85 * (m + n - shared)),
{_REACHED}
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id, doc_id <= coalesce(low.b, doc_id) AS kept
FROM s LEFT JOIN low ON low.a = doc_id
"""

ORACLE_SQL = {"op1_suffix_array": REPEATS, "op3_substrings": SUBSTRINGS, "op4_itq": VECTORS, "op10_minhash": NEAR}
