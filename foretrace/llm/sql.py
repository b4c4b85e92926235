"""DuckDB SQL with the results of the registered queries, where SQL can express them."""

ORACLES: dict[str, str] = {}

ORACLES["op10_decontaminate"] = r"""
WITH item AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), doc AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), window_of AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM window_of
), grams AS (
    SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)
), hit AS (
    SELECT g.rid, g.i, g.n, w.item_id FROM grams g JOIN window_of w ON w.n = g.n AND w.g = g.g
), covered AS (
    SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid
), items AS (
    SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c ON c.rid = d.rid LEFT JOIN items i ON i.rid = d.rid
"""

ORACLES["op8_near_duplicates"] = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
                        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM doc
), item AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pair AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN item b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b
), least_of AS (
    SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id,
       least(s.doc_id, coalesce(l.m, s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN least_of l ON l.doc_id = s.doc_id
"""

ORACLES["op4_substring_dedup"] = r"""
WITH doc AS (
    SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), win AS (
    SELECT rid, i, md5(substr(x, 2 * i + 1, 400)) AS h
    FROM (SELECT rid, x, unnest(range(0, greatest(CAST(len(x) // 2 AS BIGINT) - 199, 0))) AS i FROM doc)
), hit AS (
    SELECT w.rid, w.i FROM win w JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) r ON r.h = w.h
), marked AS (
    SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM hit
), run AS (
    SELECT rid, min(i) AS a, max(i) + 200 AS b FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS g FROM marked) GROUP BY rid, g
), piece AS (
    SELECT r.rid, r.a, substr(d.x, 2 * coalesce(lag(r.b) OVER w, 0) + 1, 2 * (r.a - coalesce(lag(r.b) OVER w, 0))) AS before, r.b
    FROM run r JOIN doc d ON d.rid = r.rid WINDOW w AS (PARTITION BY r.rid ORDER BY r.a)
), cut AS (
    SELECT rid, string_agg(before, '' ORDER BY a) AS x, max(b) AS stop, sum(b - a) AS n, count(*) AS k FROM (SELECT p.rid, p.a, p.b, p.before FROM piece p) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.k, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.rid IS NULL THEN d.x ELSE c.x || substr(d.x, 2 * c.stop + 1) END)) AS kept_sha256
FROM doc d LEFT JOIN cut c ON c.rid = d.rid
"""

ORACLES["op6_warc"] = r"""
WITH page AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hx FROM pages
), chunk AS (
    SELECT page_id, html, hx, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hx, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS c FROM page
), named AS (
    SELECT page_id, html, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((c[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1 AS BIGINT), 1)), '') AS digest FROM chunk
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id) AS k, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id) AS f FROM named
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM ranked
"""

ORACLES["op2_top_k"] = r"""
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score, c.rid AS crid
    FROM v q JOIN v c ON c.rid <> q.rid AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, crid) AS rank FROM scored) WHERE rank <= 20
"""

ORACLES["op12_hard_negatives"] = r"""
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.rid AS arid, a.vec_id AS anchor_id, c.rid AS crid, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
    FROM v a JOIN v c ON c.rid <> a.rid AND len(c.e) = len(a.e) WHERE a.vec_id % 50 = 0
), positive AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, crid) AS place FROM scored WHERE same) WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.arid, p.place ORDER BY n.score DESC, n.vec_id, n.crid) AS rank
    FROM positive p JOIN scored n ON n.arid = p.arid AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
) WHERE rank <= 3
"""
