"""DuckDB SQL for the queries that SQL can express, in the direct form."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = (rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def grams(n: int) -> str:
    """Lists of ``n`` consecutive words of ``w``; all of them if there are fewer."""
    return (f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [w] ELSE "
            f"[w[i:i + {n - 1}] FOR i IN range(1, len(w) - {n - 2})] END")


JACCARD = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_sort(list_distinct({grams(5)})) AS s
  FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
sets AS MATERIALIZED (
  SELECT s, row_number() OVER () AS sid, min(doc_id) AS d, count(*) AS n
  FROM docs WHERE len(s) > 0 GROUP BY s),
each AS MATERIALIZED (SELECT sid, len(s) AS size, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.sid AS a, b.sid AS b FROM each a JOIN each b ON a.g = b.g AND a.sid <> b.sid
  GROUP BY a.sid, b.sid, a.size, b.size
  HAVING count(*) * 5 >= (a.size + b.size - count(*)) * 4),
reach(a, b) AS (
  SELECT sid, sid FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS sid, min(d) AS class_id FROM reach JOIN sets ON sid = b GROUP BY a),
degree AS (SELECT a AS sid, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links,
  coalesce(n, 1) - 1 AS n_copies
FROM docs LEFT JOIN sets USING (s) LEFT JOIN classes USING (sid) LEFT JOIN degree USING (sid)"""

ESCAPED = r"regexp_replace(coalesce({}, ''), '(\\*)(###|</turn>)', '\\\1\2', 'g')"
CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
    (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), ''
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), ''
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({ESCAPED.format('role')}) + length({ESCAPED.format('text')}) + 15) AS BIGINT)
    AS formatted_chars
FROM turns GROUP BY conv_id"""

DECONTAMINATION = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS MATERIALIZED (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, g, len(g) AS size
  FROM (SELECT item_id, unnest({grams(10)}) AS g
        FROM (SELECT item_id, {WORDS} AS w FROM benchmark))),
places AS (
  SELECT doc_id, i, size, w[i:i + size - 1] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
    (SELECT DISTINCT size FROM windows) WHERE i + size - 1 <= len(w)),
hits AS MATERIALIZED (SELECT doc_id, i, size, item FROM places JOIN windows USING (g, size)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES = {"op4_ngram_jaccard_join": JACCARD, "op5_chat_formatting": CHAT,
           "op6_benchmark_decontamination": DECONTAMINATION}
