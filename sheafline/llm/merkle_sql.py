"""DuckDB SQL of the Merkle manifest."""

OP13 = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS round, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, round + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE round < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE round = 8
), f AS (
  SELECT doc_id, source, doc_id::VARCHAR AS id, n_chars::VARCHAR AS n, lang, text, replace(text, chr(10), '') AS cut,
    [4294967295::BIGINT] || [('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..')] AS b
  FROM documents
), g AS (
  SELECT doc_id, source, cut, text,
    coalesce(octet_length(encode(id)) || ':' || id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n)) || ':' || n, '-') AS head,
    xor(list_reduce(b, lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 2 = 0 AS hit
  FROM f, crc
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(octet_length(encode(cut)) || ':' || cut, '-')) END AS changed FROM g
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM leaves
), grown AS (
  SELECT source, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM grown WHERE n > 1 GROUP BY source, level, pos // 3
), subroots AS (
  SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM grown WHERE n = 1
), crown AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 3
), root AS (
  SELECT h AS root, level AS summit FROM crown WHERE n = 1
), edges AS (
  SELECT a.source, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM grown a JOIN grown b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 3 = b.pos // 3
  GROUP BY a.source, a.level, a.pos
), tops AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM crown a JOIN crown b ON a.level = b.level AND a.pos // 3 = b.pos // 3 GROUP BY a.level, a.pos
), climb AS (
  SELECT p.doc_id, p.source, p.leaf, p.pos AS start, 0 AS level, p.pos, coalesce(changed, leaf) AS folded, '' AS proof FROM placed p
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.start, c.level + 1, c.pos // 3, sha256(e.lo || c.folded || e.hi), c.proof || e.lo || e.hi
  FROM climb c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source
  JOIN edges e ON e.source IS NOT DISTINCT FROM c.source AND e.level = c.level AND e.pos = c.pos
  WHERE c.level < s.height
), rise AS (
  SELECT c.doc_id, c.leaf, c.start, s.subroot, c.source, 0 AS level, s.pos, c.folded, c.proof
  FROM climb c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source AND c.level = s.height
  UNION ALL
  SELECT r.doc_id, r.leaf, r.start, r.subroot, r.source, r.level + 1, r.pos // 3, sha256(t.lo || r.folded || t.hi), r.proof || t.lo || t.hi
  FROM rise r JOIN tops t ON t.level = r.level AND t.pos = r.pos, root WHERE r.level < summit
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM rise JOIN root ON level = summit
"""
