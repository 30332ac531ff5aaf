"""DuckDB SQL of operators 2 and 7; that of 3, 4 and 8 stands beside them. The others tokenize, hash or learn in ways SQL lacks."""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d
), g AS (
  SELECT doc_id, i, array_to_string(words[i + 1 : i + 13], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 12, 0))) AS i FROM d)
), f AS (
  SELECT gram, min(doc_id) AS first FROM g GROUP BY gram
), h AS (
  SELECT g.doc_id, g.i FROM g JOIN f ON g.gram = f.gram WHERE g.doc_id > f.first
), c AS (
  SELECT w.doc_id, w.i, w.word, coalesce(sum(CASE WHEN h.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM w LEFT JOIN h ON h.doc_id = w.doc_id AND h.i = w.i
), a AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words, least(len({_WORDS}), 10) AS k FROM benchmark
), g AS (
  SELECT DISTINCT item, k, words[i + 1 : i + k] AS terms, array_to_string(words[i + 1 : i + k], ' ') AS gram FROM (SELECT item, words, k, unnest(range(len(words) - k + 1)) AS i FROM b WHERE k > 0)
), w AS (
  SELECT doc_id, k, i, array_to_string(words[i + 1 : i + k], ' ') AS gram FROM (SELECT doc_id, words, k, unnest(range(greatest(len(words) - k + 1, 0))) AS i FROM d, (SELECT DISTINCT k FROM g))
), m AS (
  SELECT w.doc_id, w.i, w.k, g.item FROM w JOIN g ON w.k = g.k AND w.gram = g.gram
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p FROM (SELECT DISTINCT doc_id, i, k, unnest(range(i, i + k)) AS p FROM m)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
), tokens AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d
), freq AS (
  SELECT word, count(*) AS n FROM tokens GROUP BY word
), parts AS (
  SELECT gram, unnest(terms) AS word, unnest(range(k)) AS o FROM (SELECT DISTINCT gram, terms, k FROM g)
), rarest AS (
  SELECT gram, first(p.word ORDER BY coalesce(f.n, 0), o) AS word FROM parts p LEFT JOIN freq f ON f.word = p.word GROUP BY gram
), spots AS (
  SELECT DISTINCT r.gram, t.doc_id, t.i FROM rarest r JOIN tokens t ON t.word = r.word
), close AS (
  SELECT DISTINCT s.doc_id, g.item FROM spots s JOIN d ON d.doc_id = s.doc_id JOIN g ON g.gram = s.gram WHERE list_has_all(d.words[greatest(s.i - 9, 1) : s.i + 11], g.terms)
), near AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM close GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(near.n, 0) AS BIGINT) AS near_items, sha256(coalesce(near.listed, '')) AS near_sha256
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id
"""
