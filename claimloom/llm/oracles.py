"""DuckDB SQL for the text queries that SQL can express over whole tables."""

MIX_SOURCES = """
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::BIGINT AS n FROM documents GROUP BY source
), shares AS (
  SELECT source, n, CASE WHEN n > 0 THEN 1.0::DOUBLE * (pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM sizes WHERE n > 0))
    * (SELECT sum(n) FROM sizes)::DOUBLE / n ELSE 1.0 END AS rate FROM sizes
), terms AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p
  FROM shares, range(0, 1000) r(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)
), steps AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM terms
), drawn AS (
  SELECT d.*, ('0x' || substr(md5('mix-1|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d
), counts AS (
  SELECT d.doc_id, count(*) FILTER (WHERE s.upto <= d.u) AS n
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INTEGER AS copy, md5('mix-1|order|' || d.doc_id || '|' || c.copy) AS mix_key
FROM documents d JOIN (SELECT doc_id, unnest(range(0, n)) AS copy FROM counts) c USING (doc_id)
"""

RANKED_SEARCH = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, totals GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // terms)))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

PREFIX_TRIE = """
WITH RECURSIVE checks AS (
  SELECT conv_id, conv_id::VARCHAR AS rest, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, rest[2:], list_reduce(list_prepend(xor(crc, ascii(rest)::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))
  FROM checks WHERE rest <> ''
), heads AS (
  SELECT conv_id, xor(crc, 4294967295) % 6 AS h FROM checks WHERE rest = ''
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT c.conv_id, o.place, o.role, o.text FROM heads c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.place <= c.h
  UNION ALL
  SELECT c.conv_id, o.place + 1000000, o.role, o.text FROM heads c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, length(text) AS chars, md5(role || chr(31) || text) AS turn FROM rebuilt
), paths AS (
  SELECT conv_id, depth, chars, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM numbered
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM heads
), steps AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY conv_id) AS total FROM paths
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = total), '')) AS ends_sha256
  FROM steps GROUP BY node
), children AS (
  SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), under AS (
  SELECT node AS top, node, parent FROM nodes
  UNION ALL
  SELECT u.top, n.node, n.parent FROM under u JOIN nodes n ON n.parent = u.node
), sums AS (
  SELECT u.top AS node, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM under u JOIN nodes n USING (node) LEFT JOIN children c USING (node) GROUP BY u.top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, r.top IS NOT NULL AND k.doc_id < r.top AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
