"""DuckDB SQL for the queries that SQL can express, independent of the operators."""

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_transform(range(1, len(w) - 2), lambda i : w[i:i + 3]) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r(k, v) AS (
  SELECT a AS k, a AS v FROM e UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.v
), m AS (
  SELECT k, min(v) AS m FROM r GROUP BY k
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id,
  d.doc_id = coalesce(m.m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.k = d.doc_id
"""

BLANK = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP5 = rf"""
WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), k AS (
  SELECT *, {LOWER.format(f"trim(line, {BLANK})")} AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), m AS (
  SELECT k.*, f.owner IS NULL OR f.owner = doc_id AS stays FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP3 = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x : floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10 = r"""
WITH b AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM pages
), q AS (
  SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x : x <> '' AND string_split(x, '=')[1]
      NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'gclid', 'fbclid'))), '&') AS query
  FROM b
), c AS (
  SELECT page_id, html, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url,
    '"' || md5(coalesce(html, '')) || '"' AS tag, 't' || (page_id // 4) AS modified
  FROM q
), v AS (
  SELECT *, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"stale"' WHEN page_id % 2 = 0 THEN 'W/' || tag ELSE tag END AS sent,
    CASE WHEN page_id % 3 = 0 THEN modified END AS since
  FROM c
), m AS (
  SELECT v.page_id, v.url, v.sent, v.since, max(r.page_id) AS found FROM v LEFT JOIN c r ON r.url = v.url AND r.page_id * 10 < v.page_id * 10 + 55 GROUP BY ALL
), o AS (
  SELECT m.*, r.tag, r.modified, r.html, CASE WHEN m.found IS NULL THEN 'no earlier response'
    WHEN m.sent IS NOT NULL THEN CASE WHEN replace(m.sent, 'W/', '') = r.tag THEN 'resolved' ELSE 'etag mismatch' END
    WHEN m.since = r.modified THEN 'resolved' ELSE 'last-modified mismatch' END AS outcome
  FROM m LEFT JOIN c r ON r.page_id = m.found
)
SELECT page_id * 2 + 1 AS record_id, url AS canonical_url, found * 2 AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-type: text/html', 'date: ' || (page_id * 10 + 55),
    'etag: ' || coalesce(sent, tag), 'last-modified: ' || coalesce(since, modified)) END AS headers,
  CASE WHEN outcome = 'resolved' THEN sha256(html) END AS payload_sha256
FROM o
"""

ORACLES = {
    "op10_warc_revisits": OP10,
    "op3_topk_search": OP3,
    "op1_minhash_dedup": OP1,
    "op5_line_dedup": OP5,
}
