"""DuckDB SQL for those pipeline queries that SQL can express on whole tables."""

from __future__ import annotations

_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10"""

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, l.n, array_to_string(list_slice(w, i, i + l.n - 1), ' ') AS s FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - l.n + 2)) AS t(i)),
m AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) AS y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN x ON d.doc_id = x.doc_id"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT html AS f_html, min(page_id) AS f_id FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((((instr('0123456789abcdef', substr(x, CAST(5 * i // 4 AS INTEGER) + 1, 1)) - 1) * 16
    + instr('0123456789abcdef', substr(x, CAST(5 * i // 4 AS INTEGER) + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = f_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f_id THEN f_id END AS refers_to
FROM p JOIN f ON html = f_html"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh AS x JOIN sh AS y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, y) AS component_id, d.doc_id = least(d.doc_id, y) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = x"""

# The table of CRC-32 is built by its rule, eight steps for each byte; the walk
# of the hash and the sum over a text's bytes are recursions.
OP1 = """
WITH RECURSIVE
t(i, k, c) AS (SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15)) AS BIGINT) AS key FROM documents),
sums AS (SELECT doc_id, key, CAST(length(h) // 2 + 16 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a >> 8, l[CAST((xor(a, b) & 255) + 1 AS INTEGER)])), 4294967295) AS text_crc32 FROM d, crc),
walk(key, n, k, b, j) AS (SELECT DISTINCT key, n, CAST(key AS HUGEINT), -1.0::DOUBLE, 0.0::DOUBLE FROM d, (VALUES (40), (41)) AS v(n)
  UNION ALL SELECT key, n, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / CAST((k2 // 8589934592) + 1 AS DOUBLE))) FROM
  (SELECT key, n, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < n) AS w),
s AS (SELECT key, CAST(max(CASE WHEN n = 40 THEN b END) AS INTEGER) AS shard, CAST(max(CASE WHEN n = 41 THEN b END) AS INTEGER) AS grown_shard FROM walk WHERE j >= n GROUP BY key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY (sums.key + text_crc32) % 64, doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard FROM sums JOIN s ON sums.key = s.key"""

ORACLES = {"op1_sharding": OP1, "op4_topk": OP4, "op5_decontamination": OP5, "op6_warc": OP6, "op9_near_duplicates": OP9}
