"""DuckDB SQL that gives the rows of queries of this subpackage by the plain definition."""

OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM sets s LEFT JOIN least ON a = s.doc_id
"""

#: text_crc32 goes byte by byte through the table of the polynomial EDB88320, of which t holds the 256 entries.
OP10 = r"""
WITH RECURSIVE bits AS (
  SELECT n, 0 AS k, n AS c FROM range(256) r(n)
  UNION ALL SELECT n, k + 1, xor(c >> 1, (c & 1) * 3988292384) FROM bits WHERE k < 8),
t AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
facts AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) END AS text_crc32
  FROM documents, t),
ranked AS (
  SELECT *, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash, coalesce('s' || source, 'n') AS stratum,
    row_number() OVER (PARTITION BY source ORDER BY md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) AS rank,
    count(*) OVER (PARTITION BY source) AS rows
  FROM facts),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank - 1) / (2 * rows), stratum, hash, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS place,
    count(*) OVER () AS total
  FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(place * 24 // total AS INT) AS shard,
  CAST(place - (place * 24 // total * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
"""
