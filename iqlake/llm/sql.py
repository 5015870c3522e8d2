"""DuckDB SQL that gives the same rows as the registered corpus queries."""

from __future__ import annotations

from .archive import REVISIT_BYTES
from .chat import NARRATORS
from .importance import BUCKETS, LEAST_WORDS, PERCENT, SEED
from .sharding import HASH_BITS, SHARD_BYTES

WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest,
  CASE WHEN b >= {REVISIT_BYTES} AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= {REVISIT_BYTES} AND f <> page_id THEN f END AS refers_to
FROM m
"""

# Parts of one key that is over the limit by itself have no fixed order, so they have a null part here and no size
SHARDING = f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::bigint AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint AS h FROM documents),
lev AS (SELECT unnest(range(0, {HASH_BITS} + 1)) AS depth),
s AS (SELECT depth, h >> ({HASH_BITS} - depth)::int AS prefix, sum(bytes)::bigint AS b, count(*) AS n FROM r, lev GROUP BY 1, 2),
ok AS (SELECT * FROM s WHERE b <= {SHARD_BYTES}),
best AS (SELECT h, min(ok.depth) AS depth FROM (SELECT DISTINCT h FROM r), lev JOIN ok ON ok.depth = lev.depth AND ok.prefix = h >> ({HASH_BITS} - lev.depth)::int GROUP BY 1)
SELECT r.doc_id, r.bytes, coalesce(best.depth, {HASH_BITS})::int AS depth, coalesce(ok.prefix, r.h) AS prefix, CASE WHEN ok.b IS NOT NULL THEN 0::bigint END AS part,
  ok.b AS shard_bytes, ok.n AS shard_rows
FROM r LEFT JOIN best ON best.h = r.h LEFT JOIN ok ON ok.depth = best.depth AND ok.prefix = r.h >> ({HASH_BITS} - best.depth)::int
"""

_NARR = ", ".join(f"'{r}'" for r in NARRATORS)
CHAT = f"""
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn::bigint AS turn, role,
    coalesce(url_encode(role), '%') AS name, coalesce(role IN ({_NARR}), false) AS narrates,
    replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role NULLS FIRST, said) AS rn FROM t),
w AS (SELECT DISTINCT conv_id, lone, role AS participant FROM q WHERE NOT narrates),
s AS (SELECT q.*, participant, role IS NOT DISTINCT FROM participant AS own,
    '<|im_start|>' || CASE WHEN role IS NOT DISTINCT FROM participant THEN 'assistant' WHEN narrates THEN 'system'
      ELSE 'user name=' || name END || chr(10) AS head, said || '<|im_end|>' AS body
  FROM q JOIN w ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.lone IS NOT DISTINCT FROM w.lone),
z AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, lone, participant ORDER BY rn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint + length(head) AS a FROM s)
SELECT conv_id, participant, count(*) AS n_turns, count(*) FILTER (own) AS n_trained,
  string_agg(head || body || chr(10), '' ORDER BY rn) AS text,
  string_agg(a::varchar || '-' || (a + length(body))::varchar, ';' ORDER BY rn) FILTER (own) AS mask
FROM z GROUP BY conv_id, lone, participant
"""

# CRC-32 byte by byte: the table's 256 entries by eight steps each, then one step per byte of a feature
IMPORTANCE = f"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
docs AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents),
texts AS (SELECT side, row, text FROM docs UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark),
w AS (SELECT side, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, row, unnest(w) AS f FROM w
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS b FROM bytes, tab),
k AS (SELECT side, row, b FROM runs JOIN hashed USING (f)),
n AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM k GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1)::double * ((SELECT sum(s) FROM n)::double + {BUCKETS}) / ((s + 1)::double * ((SELECT sum(t) FROM n)::double + {BUCKETS}))))::bigint AS gain FROM n),
x AS (SELECT row, count(*) AS n, sum(gain)::bigint AS weight FROM k JOIN g USING (b) WHERE side = 'd' GROUP BY row),
y AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= {LEAST_WORDS} AS able,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score
  FROM docs LEFT JOIN x USING (row) JOIN (SELECT row, w FROM w WHERE side = 'd') USING (row)),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST, n_features DESC, weight DESC) AS r FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= {PERCENT} * (SELECT count(*) FROM y WHERE able) // 100 THEN r END AS rank FROM z
"""
