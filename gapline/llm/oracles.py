"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from gapline.llm.queries import URL_RULES
from gapline.llm.url_filter import parse_rule

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in map(parse_rule, URL_RULES))

#: A-Z lower-cased, and words, as the queries take them.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT key, min(doc_id) AS first FROM w GROUP BY key HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM w JOIN f USING (key) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS words FROM p ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORDS}) AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c WHERE 100 * shared >= 85 * (n - shared)),
reach(doc_id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.far),
parts AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id),
links AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM s JOIN parts USING (doc_id) LEFT JOIN links USING (doc_id)
"""

_BENCHMARK_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_BENCHMARK_WORDS}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, {_BENCHMARK_WORDS}) AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS key
  FROM (SELECT item_id, ws, least(len(ws), 10) AS size, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
keys AS (SELECT DISTINCT size, key FROM iw),
dw AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS key
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM iw) z WHERE len(ws) >= size)),
h AS (SELECT doc_id, i, size, key FROM dw SEMI JOIN keys USING (size, key)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h JOIN iw USING (size, key)) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP6 = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) < 1000 OR page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

_BATCHES = r"""
WITH d AS (
  SELECT doc_id, doc_id % 2 = 0 AS early, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY early DESC, n DESC, doc_id)
QUALIFY NOT early
"""

OP9 = rf"""
WITH rules(host, path, verdict) AS (VALUES {_RULES}),
p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (
  SELECT q.page_id, max_by(struct_pack(r := r.host || r.path, v := r.verdict), length(r.host || r.path)) AS best
  FROM q JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
  GROUP BY q.page_id)
SELECT q.page_id, q.host, q.path, m.best.r AS rule, coalesce(m.best.v, 'allow') AS verdict
FROM q LEFT JOIN m USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op4_ngram_join": OP4, "op10_decontaminate": OP10, "op6_warc": OP6, "op7_exact_dedup": OP7, "op9_url_filter": OP9, "exact_dedup_batches": _BATCHES}
