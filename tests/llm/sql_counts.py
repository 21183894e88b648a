"""DuckDB SQL for the columns of queries that SQL can express in part."""

import zlib

from deltaweave.llm.sql import LOWER, WORD


def crc32_is(ids, modulus, remainder):
    """SQL that tells ids with a crc32 (DuckDB has none) from others: a list of them."""
    found = [i for i in ids if zlib.crc32(str(i).encode()) % modulus == remainder]
    return f"doc_id IN ({', '.join(map(str, found)) or 'NULL'})"


_IDS = range(0, 2000)

OP6_COUNTS = rf"""
WITH w AS (
  SELECT doc_id, coalesce({crc32_is(_IDS, 7, 2)}, false) AS held, list_append(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}'), '') AS w FROM documents
), t AS (
  SELECT doc_id, held, unnest(w) AS token FROM w
), c AS (
  SELECT token, count(*) AS c FROM t WHERE NOT held GROUP BY token
), n AS (
  SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c
)
SELECT doc_id, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens, sum(log10((coalesce(c.c, 0) + 1) / (n.n + n.v + 1))) AS base_score
FROM t LEFT JOIN c USING (token) CROSS JOIN n GROUP BY doc_id
"""
