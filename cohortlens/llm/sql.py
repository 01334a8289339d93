"""DuckDB SQL of the corpus queries that SQL can express."""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACED = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {SPACED}) AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
    SELECT doc_id AS node, doc_id AS reach FROM documents
    UNION SELECT r.node, ends.b FROM r JOIN ends ON r.reach = ends.a
), c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON node = doc_id LEFT JOIN n USING (doc_id)
"""

UNBROKEN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP5 = rf"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {UNBROKEN}) AS ws FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), {UNBROKEN}) AS ws FROM benchmark
), v AS (
    SELECT DISTINCT item_id, least(len(ws), 13) AS n,
        unnest([array_to_string(ws[i:i + 12], ' ') FOR i IN range(1, greatest(len(ws) - 12, 1) + 1)]) AS g
    FROM b WHERE len(ws) > 0
), l AS (SELECT DISTINCT n FROM v
), d AS (
    SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM w, l WHERE len(ws) >= n
), h AS (
    SELECT doc_id, i, d.n, item_id FROM d JOIN v ON d.n = v.n AND array_to_string(ws[i:i + d.n - 1], ' ') = g
), p AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

# Parameters of the query: budget 1, entropy 0.95 of the largest, 4 passes at most, seed 0.
def _Z(k):  # sum of powers of the shares
    return f"list_sum([pow(p, {k}) FOR p IN ps])"


def _H(k):  # entropy of the weights
    return f"(ln({_Z(k)}) - {k} * list_sum([pow(p, {k}) * ln(p) FOR p IN ps]) / {_Z(k)})"


def _R(k):  # most passes over a source
    return f"(list_max([pow(p, {k} - 1) FOR p IN ps]) / {_Z(k)})"


OP9 = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce('=' || source, '-') AS g,
        md5(coalesce('=' || doc_id::VARCHAR, '-') || chr(31) || coalesce('=' || text, '-')) AS k,
        len(regexp_extract_all(coalesce(text, ''), {SPACED}))::BIGINT AS n
    FROM documents
), t AS (SELECT g, sum(n)::BIGINT AS t, count(*) AS rows FROM d GROUP BY g
), s AS (SELECT g, t / (SELECT sum(t) FROM t) AS p FROM t WHERE t > 0
), l AS (SELECT list(p) AS ps, ln(count(*)) AS most, 0.95 * ln(count(*)) AS goal FROM s
), h AS (
    SELECT 0 AS i, 0.0::DOUBLE AS lo, 64.0::DOUBLE AS hi UNION ALL
    SELECT i + 1, CASE WHEN {_H('m')} <= goal THEN lo ELSE m END, CASE WHEN {_H('m')} <= goal THEN m ELSE hi END
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m FROM h), l WHERE i < 70
), t1 AS (
    SELECT CASE WHEN len(ps) < 2 OR {_H('0')} - {_H('64')} < 1e-12 THEN 1.0 WHEN {_H('0')} <= goal + 1e-12 THEN 0.0
        WHEN {_H('64')} > goal THEN 64.0 ELSE hi END AS e
    FROM h, l WHERE i = 70
), r AS (
    SELECT 0 AS i, e AS bad, 1.0::DOUBLE AS good FROM t1 UNION ALL
    SELECT i + 1, CASE WHEN {_R('m')} <= 4 * (1 + 1e-12) THEN bad ELSE m END, CASE WHEN {_R('m')} <= 4 * (1 + 1e-12) THEN m ELSE good END
    FROM (SELECT i, bad, good, (bad + good) / 2 AS m FROM r), l WHERE i < 70
), e AS (
    SELECT CASE WHEN {_R('t1.e')} <= 4 * (1 + 1e-12) THEN t1.e ELSE good END AS e FROM t1, r, l WHERE i = 70
), told AS (
    SELECT floor(e * 1e6 + 0.5)::BIGINT AS exponent_micro, abs({_H('e')} - goal) <= 1e-6 AS entropy_met FROM e, l
), w AS (
    SELECT g, t, ceil(sqrt(rows))::BIGINT AS b, CASE WHEN t > 0 THEN floor(pow(t / (SELECT sum(t) FROM t), (SELECT e FROM e))
        / (SELECT sum(pow(p, (SELECT e FROM e))) FROM s) * (SELECT sum(t) FROM t) + 0.5)::BIGINT ELSE 0 END AS want
    FROM t
), q AS (
    SELECT g, b, CASE WHEN t > 0 THEN want // t ELSE 0 END AS passes, want - CASE WHEN t > 0 THEN want // t ELSE 0 END * t AS rest FROM w
), x AS (
    SELECT d.*, q.b, q.passes, q.rest, ('0x' || substr(md5('block0:' || passes || ':' || k), 1, 15))::BIGINT % b AS block,
        ('0x' || substr(md5('row0:' || passes || ':' || k), 1, 15))::BIGINT AS o
    FROM d JOIN q USING (g)
), c AS (
    SELECT g, block, rest, n, sum(n) OVER (PARTITION BY g ORDER BY block) AS upto
    FROM (SELECT g, block, rest, sum(n) AS n FROM x GROUP BY ALL)
), edge AS (
    SELECT g, block AS edge, rest - upto + n AS space
    FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY block) AS r FROM c WHERE rest > 0 AND upto > rest) WHERE r = 1
), u AS (
    SELECT k, sum(n) OVER (PARTITION BY g ORDER BY o, k ROWS UNBOUNDED PRECEDING) AS upto, space
    FROM (SELECT g, k, o, space, sum(n) AS n FROM x JOIN edge USING (g) WHERE block = edge GROUP BY ALL)
), f AS (
    SELECT x.*, coalesce(block < edge OR (block = edge AND k IN (SELECT k FROM u WHERE upto <= space)), false) AS also
    FROM x LEFT JOIN edge USING (g)
), y AS (SELECT *, unnest(range(0, passes + also::BIGINT)) AS epoch FROM f
)
SELECT doc_id, source, n AS n_tokens, epoch::INTEGER AS epoch, new_block AS block,
    ('0x' || substr(md5('order0:' || epoch || ':' || g || ':' || new_block), 1, 15))::BIGINT AS block_order,
    ('0x' || substr(md5('row0:' || epoch || ':' || k), 1, 15))::BIGINT AS row_order, exponent_micro, entropy_met
FROM told, (SELECT *, ('0x' || substr(md5('block0:' || epoch || ':' || k), 1, 15))::BIGINT % b AS new_block FROM y)
"""

_RECORD = r"""concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
        'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
        'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10))"""
OP6 = f"""
WITH r AS (SELECT page_id, {_RECORD} AS rec FROM pages
), o AS (
    SELECT page_id, sha256(rec) AS sha256, strlen(rec)::BIGINT AS n_bytes,
        row_number() OVER (ORDER BY page_id) - 1 AS position,
        (sum(strlen(rec)) OVER (ORDER BY page_id) - strlen(rec))::BIGINT AS "offset" FROM r
), w AS (
    SELECT CASE WHEN page_id % 211 = 3 THEN -page_id ELSE page_id END AS page_id, url,
        CASE WHEN page_id % 97 = 5 THEN html || '#' WHEN page_id % 101 = 11 THEN html[1:40] ELSE html END AS html
    FROM pages WHERE page_id % 103 != 7
), t AS (SELECT page_id AS id, sha256({_RECORD}) AS found FROM w)
SELECT coalesce(page_id, id) AS page_id, 0::BIGINT AS copy, position, "offset", n_bytes, sha256, found AS replica_sha256,
    CASE WHEN page_id IS NULL THEN 'strange' WHEN id IS NULL THEN 'missing' WHEN found = sha256 THEN 'intact' ELSE 'altered' END AS status
FROM o FULL JOIN t ON page_id = id
"""

# The CRC-32 of the decimal id, byte by byte and bit by bit; 3988292384 is its polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"""
OP12 = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', role, text))) AS r
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), b AS (
    SELECT c.conv_id, 0 AS own, r, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND r <= h
    UNION ALL SELECT t.conv_id, 1, r, role, text FROM t JOIN c USING (conv_id) WHERE r > h
), p AS (
    SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
        string_agg(md5(concat(strlen(role), ':', role, text)), '') OVER w AS k
    FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, r ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved FROM p GROUP BY k, depth
), kids AS (SELECT substr(k, 1, 32 * (depth - 1)) AS k, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1
), s AS (
    SELECT substr(k, 1, 32 * up) AS k, sum(leaf) AS n_leaves, sum(saved) AS saved
    FROM (SELECT n.k, saved, (kids.n IS NULL)::BIGINT AS leaf, unnest(range(0, depth + 1)) AS up FROM n LEFT JOIN kids USING (k)) GROUP BY 1
), e AS (
    SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY k
)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
    s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN kids USING (k) LEFT JOIN e USING (k)
    LEFT JOIN n o ON n.depth > 0 AND o.k = substr(n.k, 1, 32 * (n.depth - 1))
"""
