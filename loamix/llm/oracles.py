"""DuckDB SQL with the results of the queries that SQL can express."""

from loamix.llm.spotsigs import pattern

SQL = {
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT d.doc_id, u.i, list_extract(string_split(coalesce(d.text, ''), chr(10)), u.i) AS line
  FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS i) u),
keyed AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS max_doc FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.doc_id, keyed.i, keyed.line, hot.k IS NOT NULL AND hot.max_doc <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_sharding": r"""
WITH RECURSIVE step AS (
  SELECT unnest(range(0, 256))::BIGINT AS byte, unnest(range(0, 256))::BIGINT AS c, 0 AS k
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc_table AS (
  SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8),
bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, length(h) // 2 AS n,
         xor(4294967295::BIGINT, list_reduce(
           list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT),
           lambda c, b: xor(c >> 8, list_extract(t, (xor(c, b) & 255) + 1)), 4294967295::BIGINT)) AS crc
  FROM bytes, crc_table),
jumps AS (
  SELECT s AS shards, d.doc_id, CASE WHEN d.doc_id < 0 THEN d.doc_id::HUGEINT + 18446744073709551616 ELSE d.doc_id::HUGEINT END AS state,
         -1::BIGINT AS b, 0::BIGINT AS j
  FROM (SELECT DISTINCT doc_id FROM documents) d, (SELECT unnest([8, 9]) AS s) t
  UNION ALL
  SELECT shards, doc_id, nxt, j,
         floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((nxt // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757::HUGEINT + 1) % 18446744073709551616 AS nxt FROM jumps WHERE j < shards)),
homes AS (
  SELECT doc_id, max(b) FILTER (WHERE shards = 8)::INTEGER AS shard, max(b) FILTER (WHERE shards = 9)::INTEGER AS grown_shard
  FROM jumps GROUP BY doc_id)
SELECT doc_id, (n + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, n) - 1)::BIGINT AS slot, grown_shard
FROM sums JOIN homes USING (doc_id)
""",
    "op4_minhash": r"""
WITH RECURSIVE words AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words),
shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT reach.d, ways.b FROM reach JOIN ways ON reach.r = ways.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM sets s JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) m ON s.doc_id = m.d
""",
    "op10_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
         array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
  FROM item_words, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) u
  WHERE len(w) > 0),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS x
  FROM doc_words, (SELECT DISTINCT size FROM windows) z, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) u),
hits AS (
  SELECT p.doc_id, p.i, p.size, v.item_id FROM places p JOIN windows v ON p.size = v.size AND p.x = v.x),
hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
""",
    "op9_spotsigs": r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS following
  FROM documents
  WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, coalesce(text, ''))),
texts AS (
  SELECT doc_id, text, following, text[1:length(text) - length(text) // 2] || following[1:length(text) // 2] AS edited FROM docs),
sets AS (
  SELECT x AS t, list_sort(list_distinct(list_filter(list_transform(range(1, len(s)), lambda i:
           CASE WHEN contains(s[i], ' ') THEN
             substr(md5(string_split(s[i], ' ')[-2] || ' ' || string_split(s[i], ' ')[-1] || ' ' || string_split(s[i + 1], ' ')[-1]), 1, 8)
           END), lambda z: z IS NOT NULL))) AS sigs
  FROM (SELECT x, regexp_extract_all(
          CASE WHEN w = '' THEN '^ ~' ELSE '^ ' || w || ' ~' END, 'ANCHORED') AS s
        FROM (SELECT x, trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')) AS w
              FROM (SELECT text AS x FROM texts UNION SELECT edited FROM texts UNION SELECT following FROM texts)))),
joined AS (
  SELECT doc_id, length(text) AS n, text, edited, following, a.sigs AS a, b.sigs AS b, c.sigs AS c
  FROM texts JOIN sets a ON a.t = text JOIN sets b ON b.t = edited JOIN sets c ON c.t = following)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN len(a) = 0 AND len(b) = 0 THEN (text = edited)::INT::DOUBLE
            ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
       CASE WHEN len(a) = 0 AND len(c) = 0 THEN (text = following)::INT::DOUBLE
            ELSE len(list_intersect(a, c))::DOUBLE / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next
FROM joined
""".replace("ANCHORED", pattern(possessive=False)),
}
