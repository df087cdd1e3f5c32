"""DuckDB SQL for the rows of those queries that SQL can express, by the plainest way."""

from __future__ import annotations

from . import license_scan

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '{_GAP}'), lambda w: w <> '')"


def _windows(words: str, k: str) -> str:
    return f"list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string({words}[i:i + {k} - 1], ' '))"


OP3 = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER same AS last,
         strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER same AS again
  FROM pages WINDOW same AS (PARTITION BY coalesce(html, '')))
"""

OP4 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS k, unnest({_windows("words", "least(10, len(words))")}) AS win
  FROM items WHERE len(words) > 0),
docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
doc_windows AS (
  SELECT doc_id, k, unnest({_windows("words", "k")}) AS win, unnest(range(0, len(words) - k + 1)) AS pos
  FROM docs, (SELECT DISTINCT k FROM item_windows) WHERE len(words) >= k),
hits AS (SELECT doc_id, pos, k, item_id FROM doc_windows JOIN item_windows USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hits) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
"""

OP6 = """
WITH unit AS (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_dot_product(a.u, b.u) >= 0.95),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a) SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, count(link.b) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN reach ON vec_id = reach.a LEFT JOIN link ON vec_id = link.a
GROUP BY vec_id, component_id
"""

OP8 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN {_windows("words", "5")} WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s
  FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b, c = x.n AND c = y.n AS equal FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a) SELECT a, min(b) AS component_id FROM r GROUP BY a),
own AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE equal) AS twin FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, component_id, coalesce(n_links, 0) AS n_links, coalesce(n, 0) AS n_shingles, component_id = doc_id AS kept
FROM docs JOIN reach ON doc_id = reach.a LEFT JOIN own ON doc_id = own.a LEFT JOIN sizes USING (doc_id)
"""

OP9 = rf"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT doc_id, unnest({_windows("words", "20")}) AS win, unnest(range(0, len(words) - 19)) AS pos FROM docs WHERE len(words) >= 20),
later AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS p FROM later),
each AS (SELECT doc_id, unnest(words) AS w, unnest(range(0, len(words))) AS p FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

ORACLES = {
    "op3_warc": OP3,
    "op4_decontamination": OP4,
    "op6_embedding_dedup": OP6,
    "op8_jaccard_join": OP8,
    "op9_substring_dedup": OP9,
    "op10_license_scan": license_scan.oracle(),
}
