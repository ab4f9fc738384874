"""SQL counterparts of the queries on repeated passages, spelling variants and conversation tries."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of a text: for each byte, eight steps of the reversed polynomial 0xEDB88320."""
    digits = f"hex(encode({text}))"
    bits = f"list_transform(range(0, 4 * len({digits})), lambda k: CASE WHEN k % 8 = 0 THEN CAST('0x' || substr({digits}, CAST(k // 4 + 1 AS INT), 2) AS BIGINT) ELSE 0 END)"
    step = "xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)"
    return f"xor(list_reduce(list_concat([4294967295], {bits}), lambda a, b: {step}), 4294967295)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPELLING_VARIANTS = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (SELECT run, k, {crc32("doc_id || ':' || run")} AS h FROM counted
), slipped AS (
  SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed
), words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), places AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM words
), without AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM places
), pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM without a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM without a JOIN words w ON a.rest = w.word
), near AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS best FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best[1] >= 10 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * w.n THEN -best[1] END AS form_n
  FROM words w LEFT JOIN near USING (word)
), chains AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, c.next, f.form FROM chains c JOIN formed f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""

PREFIX_TRIE = f"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS size FROM ordered GROUP BY ALL
), convs AS (
  SELECT s.conv_id, s.base, s.size, {crc32("CAST(s.conv_id AS VARCHAR)")} % 9 AS h, coalesce(b.size, 0) AS base_size
  FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base
), turns AS (
  SELECT c.conv_id, pos AS depth, role, text FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, pos - h + least(h, base_size), role, text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos > c.h
), paths AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS n_bytes FROM convs
  UNION ALL
  SELECT conv_id, depth, sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)), strlen(text) FROM turns
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS saved FROM paths GROUP BY depth, prefix
), linked AS (
  SELECT n.*, up.prefix AS above FROM nodes n LEFT JOIN paths up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
), children AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM linked n LEFT JOIN children USING (depth, prefix)
), totals AS (
  SELECT up.depth, up.prefix, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM valued v JOIN paths up ON up.conv_id = v.conv_id AND up.depth <= v.depth GROUP BY ALL
), lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), ends AS (
  SELECT depth, prefix, sha256(string_agg(conv_id, ',' ORDER BY conv_id)) AS ends_sha256 FROM paths JOIN lengths USING (conv_id, depth) GROUP BY ALL
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM valued v JOIN totals USING (depth, prefix) LEFT JOIN ends USING (depth, prefix)
LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.prefix = v.above
"""

#: Ids that are null come after all others, as in the operator.
REPEATED_WINDOWS = r"""
WITH texts AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT place, doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM texts WHERE len(words) >= 13),
windows AS (SELECT place, doc_id, pos, array_to_string(list_slice(words, pos, pos + 12), ' ') AS win FROM starts),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win HAVING count(*) > 1),
hits AS (SELECT place, pos FROM windows JOIN firsts USING (win) WHERE first < doc_id OR doc_id IS NULL AND first IS NOT NULL),
gone AS (SELECT DISTINCT place, unnest(range(pos, pos + 13)) AS pos FROM hits),
each AS (SELECT place, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM texts),
kept AS (SELECT place, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (place, pos) GROUP BY place)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (place)
"""
